"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featureops.llm import bpe, decontaminate, fingerprint, lm, ngram_join, pii, quality, repeats, toxicity, wrappers

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [
    (1, A), (2, A), (2, A), (3, A.replace("pi", "PI")), (4, None), (5, ""), (6, "  \n\t "), (None, A), (None, None),
    (7, "mail me: a.b@c.example.org or 10.0.0.300"), (8, LONG), (9, LONG + " end"), (9, "other text under the same id"), (10, "ünï çödé 😀 text"),
]
CLASH = ["word", "n", "p", "h", "term", "key", "root", "set_id", "copies", "values", "run", "pos", "y", "kind", "spans", "score", "_t", "_n", "uid", "ids"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(3, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, A), (2, None), (3, ""), (1, A)], "item_id long, text string").withColumn("doc_id", F.lit(1))


def test_join(docs):
    got = ngram_join.joined(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.n_copies))
    # A stands in rows 1, 2, 2, 3 (capitals aside) and one without doc_id
    assert by[1] == [(1, 4, 4)] and by[2] == [(1, 4, 4)] * 2 and by[3] == [(1, 4, 4)]
    assert by[4] == [(4, 3, 3)] and by[5] == [(4, 3, 3)] and by[6] == [(4, 3, 3)]
    assert sorted(by[None], key=str) == [(1, 4, 4), (4, 3, 3)]
    assert by[8] == [(8, 1, 0)] and sorted(by[9]) == [(8, 1, 0), (9, 0, 0)] and by[10] == [(10, 0, 0)]
    assert ngram_join.joined(docs.limit(0)).count() == 0


def test_quality_and_toxicity(docs, labels):
    for module in (quality, toxicity):
        got = module.scored(docs, labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
        none = module.scored(docs, labels.limit(0)).collect()
        assert {r.score for r in none} == {0.5}
        assert module.scored(docs.limit(0), labels).count() == 0
        one = module.scored(docs, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})).collect()
        assert all(r.score > 0.5 for r in one)


def test_pii(docs):
    got = pii.detected(docs).collect()
    assert len(got) == len(ROWS)
    row = next(r for r in got if r.doc_id == 7)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.spans) == (1, 0, 0, 0, "email:9:26")
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in got if r.doc_id in (4, 5, 6, 8))
    assert pii.detected(docs.limit(0)).count() == 0


def test_leaks(docs, benchmark):
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted([(d, 1) for d in (1, 2, 2, 3, None)] * 2, key=str)
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def test_encoding(docs):
    got = bpe.coded(docs, bpe.public_vocabulary(), with_ids=True).collect()
    assert len(got) == len(ROWS)
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert {r.decoded_sha256 for r in got} == texts and all(r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}


def test_fingerprints(docs):
    got = fingerprint.compared(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.fingerprint, r.edited_fingerprint, r.near_edited, r.n_chars) for r in got if r.doc_id is None and r.n_chars == 0} == {("", "", 1.0, 0)}
    same = {r.fingerprint for r in got if r.n_chars == len(A) and r.doc_id != 3}
    assert len(same) == 1
    one = next(r for r in got if r.doc_id == 1)  # the lowest: the highest comes next
    half = len(A) // 2
    assert one.edited_sha256 == hashlib.sha256((A[: len(A) - half] + "ünï çödé 😀 text"[:half]).encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compared(docs.limit(0)).count() == 0


def test_packed_fingerprints(spark):
    """Fingerprints are stored and shuffled in 136 bytes instead of 256 letters, and come back as they were."""
    full = "".join(f"{i * 1021:04X}" for i in range(64))
    signs = ["", full, full[:128] + "----" * 32, "----" * 63 + "0000", "0000" + "----" * 63, "----" + full[4:252] + "----"]
    df = spark.createDataFrame([(s,) for s in signs], "s string").withColumn("b", fingerprint.packed(F.col("s")))
    got = df.select("s", F.length("b").alias("n"), fingerprint.unpacked(F.col("b")).alias("again")).collect()
    assert [(r.s, r.again) for r in got] == [(s, s) for s in signs] and [r.n for r in got] == [0] + [136] * 5


def test_scores(docs):
    got = lm.scored(docs).collect()
    assert len(got) == len(ROWS)
    empty = [r for r in got if r.doc_id in (4, 5, 6)]
    assert {r.n_tokens for r in empty} == {1} and len({r.base_score for r in empty}) == 1
    assert all(r.base_score < 0 and r.score < 0 for r in got)
    assert lm.scored(docs.limit(0)).count() == 0
    none = lm.scored(docs.where("doc_id in (4, 1)"), hold_mod=1).collect()  # all rows held out
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(True, 0, 0, None, None)}


def test_repeats(docs):
    got = [(r.doc_id, r.start, r.end, r.n_words) for r in repeats.repeated(docs).collect()]
    assert sorted(got) == [(8, 0, len(LONG), 30_000), (9, 0, len(LONG), 30_000)]
    assert repeats.repeated(docs.limit(0)).count() == 0


def test_pages(spark):
    page = "<body><nav><a>x</a></nav><article><p>one&amp;two<p>three</article><footer>f</footer>"
    rows = [(1, "http://a/1", page), (1, "http://a/1", page), (2, None, page), (3, "http://a/3", None), (4, "http://a/4", ""), (None, "http://b", "<p>" * 20_000 + "deep"), (5, "http://a/5", "<div " + "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in ("host", "wrapper", "text", "place")))
    got = wrappers.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got if r.page_id != 5) == [(0, "deep"), (1, "one&two\n\nthree"), (1, "one&two\n\nthree"), (2, "one&two\n\nthree"), (3, ""), (4, "")]
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert wrappers.extracted(pages.limit(0)).count() == 0


def test_stages(spark, docs, labels, benchmark, tmp_path):
    sf = str(tmp_path)
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{sf}/labels.parquet")
    benchmark.where("item_id = 9").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, sf)
    assert kept.count() == len(ROWS) and kept.columns == corpus_pipeline.COLUMNS
    single = corpus_pipeline.one_of_each(spark, docs, sf).collect()
    assert len(single) == len({(r.doc_id, r.text) for r in single})
    assert sum((r.text or "").lower() == A for r in single) == 1 and sum(not (r.text or "").strip() for r in single) == 1
    assert corpus_pipeline.not_in_benchmark(spark, docs, sf).count() == len(ROWS)
    clean = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs, sf).collect()}
    assert clean[7].text == "mail me: <email> or 10.0.0.300" and clean[7].n_chars == len(clean[7].text)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
