"""Text quality by a sparse rule ensemble, compiled into column expressions.

Statistics of the whole text are columns. The labels of at most ``FIT_ROWS`` training rows (those with the
least hash of their doc_id) fit the ensemble: paths of shallow trees over the statistics are conjunctive
rules, a logistic lasso keeps and weighs some of them. The rules become one column expression; scoring is a
pass over the documents without a shuffle and without Python.

Null texts are empty and are scored as such. Repeated rows each get a row. Without labels for training the
score is one half; with labels of one class it is near that class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featureops.llm import rule_ensemble
from featureops.llm.common import remainder, table
from featureops.llm.rule_ensemble import RuleModel

FIT_ROWS = 20_000
HOLD_MOD, HELD = 3, 1
# White space, and signs that prose hardly uses.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SIGNS = "#$%&*~^=<>{}[]\\_@"


def statistics(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``keys`` and statistics of each text, and the names of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keys, text.alias("_t"), F.split(F.btrim(text, F.lit(BLANKS)), SPACE).alias("_w"), F.split(text, "\n").alias("_l"))
    without = lambda signs: F.length("_t") - F.length(F.translate("_t", signs, ""))
    counts = base.select(
        *keys, F.length("_t").cast("double").alias("_c"), F.size("_w").cast("double").alias("_n"),
        F.size(F.array_distinct("_w")).cast("double").alias("_d"), F.size("_l").cast("double").alias("_k"),
        F.size(F.array_distinct("_l")).cast("double").alias("_e"),
        without(SIGNS).cast("double").alias("_s"), without("0123456789").cast("double").alias("_f"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("|"), F.lit("")))).cast("double").alias("_p"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("."), F.lit("")))).cast("double").alias("_q"),
        (F.length("_t") - F.length(F.replace("_t", F.lit(","), F.lit("")))).cast("double").alias("_m"),
        F.size(F.filter("_l", lambda x: F.length(x) < 40)).cast("double").alias("_h"))
    c = F.col
    named = {
        "log_words": F.log1p(c("_n")), "word_length": c("_c") / (c("_n") + 1), "distinct_words": c("_d") / c("_n"),
        "distinct_decay": F.log1p(c("_d")) / F.log1p(c("_n")), "words_a_line": F.log1p(c("_n") / c("_k")), "distinct_lines": c("_e") / c("_k"),
        "signs": c("_s") / (c("_c") + 1), "digits": c("_f") / (c("_c") + 1), "bars": c("_p") / (c("_n") + 1),
        "stops": c("_q") / (c("_n") + 1), "commas": c("_m") / (c("_n") + 1), "short_lines": c("_h") / c("_k"),
    }
    return counts.select(*keys, *(e.alias(f"_{k}") for k, e in named.items())), [f"_{k}" for k in named]


def compiled(model: RuleModel, names: list[str]) -> Column:
    """Probability of label 1 as a column expression over the statistics."""
    raw = F.lit(model.bias)
    for rule, weight in model.rules:
        test = F.lit(True)
        for column, low, limit in rule:
            test = test & ((F.col(names[column]) <= limit) if low else (F.col(names[column]) > limit))
        raw = raw + F.when(test, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-raw))


def training_rows(labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """doc_id, y of the labelled rows outside the held-out part."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    return named.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (remainder(mod) != held))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> RuleModel:
    rows = training_rows(labels, "quality", HOLD_MOD, HELD).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most ``bound`` rows
    stats, names = statistics(named, ["doc_id", "y"])
    got = stats.orderBy("doc_id", "y", *names).limit(2 * bound).toPandas()
    return rule_ensemble.fit(got[names].to_numpy("f8"), got["y"].to_numpy("f8"))


def scored(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; with ``keys``, these columns instead of doc_id and held_out."""
    model = fitted(docs, labels)
    if keys is None:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(HOLD_MOD) == HELD).alias("held_out"), "text")
        keys = ["doc_id", "held_out"]
    stats, names = statistics(docs, keys)
    return stats.select(*keys, compiled(model, names).alias("score")).select(*keys, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
