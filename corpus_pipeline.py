"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. Rows without doc_id are told apart by their text. A repeated row, doc_id and
text alike, is a copy of itself and goes with the near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm import bpe, decontaminate, ngram_join, pii, quality
from featureops.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``key``: the doc_id, or where there is none the text's hash."""
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("key"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    docs = docs.select(*COLUMNS)
    # Stored before it is filtered: a filter on the score would go below the statistics and repeat them for each rule.
    scored = written(quality.scored(docs, table(spark, sf_dir, "labels"), keys=COLUMNS), "pipeline-scored")
    return scored.where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near duplicates."""
    rows = keyed(docs)
    classes = ngram_join.joined(rows.select(F.col("key").alias("doc_id"), "text"))
    firsts = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("key")).distinct()
    again = classes.where("n_copies > 0").select(F.col("doc_id").alias("key")).groupBy("key").count().where("count > 1")
    kept = rows.join(firsts, "key", "left_semi")
    # only rows that share their key with another may be repeated
    single, several = kept.join(again, "key", "left_anti"), kept.join(again, "key", "left_semi").dropDuplicates(["key", "text"])
    return single.select(*COLUMNS).union(several.select(*COLUMNS))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = keyed(docs)
    found = decontaminate.leaks(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.cleaned(docs, ["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of all documents."""
    return bpe.coded(docs, bpe.public_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]

# Fitted models and a tokenizer: not expressible in SQL. tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
