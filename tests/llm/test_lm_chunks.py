"""The language model by chunks: same scores for any size of chunks and parts, and each key listed once a chunk."""

import random

from pyspark.sql import functions as F

from featureops.llm import lm


def test_scores_do_not_depend_on_chunks_and_parts(spark, monkeypatch):
    g = random.Random(3)
    rows = [(i, " ".join(f"w{int(g.paretovariate(0.8)) % 300}" for _ in range(g.randrange(0, 60)))) for i in range(200)] + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lm.scored(docs.repartition(1)).collect()), key=str)
    assert len(want) == len(rows)
    monkeypatch.setattr(lm, "CHUNK", 150)
    monkeypatch.setattr(lm, "PART", 400)
    assert lm.chunks(docs.select("doc_id", F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))).count() > 20
    assert sorted(map(tuple, lm.scored(docs.repartition(5)).collect()), key=str) == want


def test_a_frequent_word_is_asked_once_a_chunk(spark):
    docs = spark.createDataFrame([(i, "the " * 2_000) for i in range(50)], "doc_id long, text string")
    made = lm.chunks(docs.select("doc_id", F.lit(False).alias("held_out"), "text").coalesce(1))
    told = lm.answered(made, None, lm.Chunk.asks_grams, 0, "test-counts").collect()
    assert len(told) == 2  # one list of words and one of bigrams
    words = next(lm.unpacked(bytes(r["data"])) >> 1 for r in told if r["kind"] == lm.WORDS)
    assert sorted(words.tolist()) == [50, 100_000]
