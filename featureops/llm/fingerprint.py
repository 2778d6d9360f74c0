"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The weighted terms of a text are its pairs of neighbouring words (the last word stands alone too), each
with its number of occurrences w. For a term, two gamma(2, 1) variables r and c and a uniform b come
from its hash, and t = floor(ln w / r + b) is its consistent quantum: the term's sample is
ln a = ln c - r (t - b) - r. Terms fall into ``BINS`` bins by hash, and each bin keeps its least sample.
As a sample depends only on term and quantum, two texts have the same one in a bin with a probability
equal to the generalised Jaccard similarity of their weighted terms.

Likeness of two fingerprints: equal bins over bins that either has filled. Two empty texts have
likeness 1, an empty and another text 0. Null texts are empty; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from featureops.llm.common import table, written

BINS = 64
EMPTY = "----"  # an empty bin
DIGITS = 4  # hexadecimal digits of a bin in the fingerprint
PARTS = 4  # partitions of texts for each shuffle partition
BLOCK = 10_000  # ids in a block when neighbours are looked up
# Fixed value: white space between words.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def unit(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)


def sample(term: Column, weight: Column) -> Column:
    """ln a of a term with this weight."""
    first, second = F.xxhash64(term, F.lit(1)), F.xxhash64(term, F.lit(2))
    r = -F.log(unit(first, 0) * unit(first, 21))
    c = -F.log(unit(first, 42) * unit(second, 0))
    b = unit(second, 21)
    return F.log(c) - r * (F.floor(F.log(weight) / r + b) - b) - r


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and fingerprint of each row with a word; the keys name a row.

    If the rows are already dealt out by some of the keys, nothing is shuffled: counting the terms,
    keeping the least samples and joining the bins all happen where the rows are."""
    trimmed = F.btrim(F.col(text), F.lit(BLANKS))
    split = rows.select(*keys, F.split(trimmed, SPACE).alias("words")).where(F.get("words", F.lit(0)) != "")
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    weighted = split.select(*keys, F.explode(pairs).alias("term")).groupBy(*keys, "term").agg(F.count("*").cast("double").alias("w"))
    drawn = weighted.select(*keys, F.pmod(F.xxhash64("term", F.lit(0)), F.lit(BINS)).alias("bin"), sample(F.col("term"), F.col("w")).alias("a"))
    least = drawn.groupBy(*keys, "bin").agg(F.min("a").alias("a"))
    sign = F.lpad(F.right(F.hex(F.xxhash64("a")), F.lit(DIGITS)), DIGITS, "0")
    filled = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", sign.alias("s")))).alias("bins"))
    places = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("bins", i), F.lit(EMPTY)))
    return filled.select(*keys, F.array_join(places, "").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Equal bins over the bins that one of two fingerprints has filled."""
    at = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    places = F.sequence(F.lit(0), F.lit(BINS - 1))
    same = F.size(F.filter(places, lambda i: (at(a, i) == at(b, i)) & (at(a, i) != EMPTY)))
    some = F.size(F.filter(places, lambda i: (at(a, i) != EMPTY) | (at(b, i) != EMPTY)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same / some)


def packed(sign: Column) -> Column:
    """A fingerprint in about half its room, for storing and shuffling: a bit for each empty bin, then the digits as bytes.
    Digits of hashes don't compress where only repetitions are looked for."""
    at = lambda i: F.substring(sign, i * DIGITS + 1, F.lit(DIGITS))
    places = F.sequence(F.lit(0), F.lit(BINS - 1))
    bits = F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.shiftleft(m, 1).bitwiseOR(F.when(at(i) == EMPTY, 1).otherwise(0).cast("long")))
    whole = F.unhex(F.concat(F.lpad(F.hex(bits), BINS // 4, "0"), F.translate(sign, "-", "0")))
    return F.when(sign == "", F.lit(b"")).otherwise(whole)


def unpacked(bytes_: Column) -> Column:
    """The fingerprint that was packed."""
    digits = F.hex(bytes_)
    nibble = lambda i: F.conv(F.substring(digits, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    empty = lambda i: F.element_at(F.array(*[nibble(i).bitwiseAND(F.lit(b)) for b in (8, 4, 2, 1)]), i % 4 + 1) != 0
    at = lambda i: F.substring(digits, i * DIGITS + 1 + BINS // 4, F.lit(DIGITS))
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.when(empty(i), EMPTY).otherwise(at(i))), "")
    return F.when(F.length(bytes_) == 0, "").otherwise(whole)


def following(ids: DataFrame) -> DataFrame:
    """``ids`` (id, half) with next_id: the next lower id, after the lowest the highest. Ids are distinct and not null.

    Neighbours are found within blocks of ids; only one row for each block is put in a single order."""
    block = F.floor(F.col("id") / BLOCK)
    inside = ids.select("id", "half", block.alias("block"), F.lead("id").over(Window.partitionBy(block).orderBy(F.desc("id"))).alias("next_id"))
    tops = ids.groupBy(block.alias("block")).agg(F.max("id").alias("top"))
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("block"))
    whole = Window.partitionBy(F.lit(0))
    after = tops.select("block", F.coalesce(F.lead("top").over(every), F.max("top").over(whole)).alias("after"))
    return inside.join(after, "block").select("id", "half", F.coalesce("next_id", "after").alias("next_id"))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document in descending doc_id; after the lowest comes the highest. A row without doc_id has
    the empty text as its next document. Of several texts with the next doc_id, the one with the least
    hash is taken; a row that is repeated as it is gets its result as often.

    Texts are shuffled once, by doc_id; beside them only the heads that the edits need, and fingerprints."""
    h = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # p deals rows out by doc_id, and those without one by their text.
    rows = rows.select(F.coalesce("doc_id", h).alias("p"), "doc_id", h.alias("h"), "text")
    # the terms of a text take some twenty times its room while they are counted
    rows = rows.repartition(PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p")
    rows = rows.groupBy("p", "doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    size = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int").alias("half"))
    wanted = following(named.groupBy("id").agg(F.max("half").alias("half")))
    asked = wanted.select(F.col("next_id").alias("p"), "id", "half")
    # no filter on the rows here, or it would go below their exchange, which all branches share
    heads = rows.select("p", "doc_id", "h", "text").join(asked, "p")
    heads = heads.select("id", "h", F.when(F.col("doc_id").isNotNull(), F.substring("text", F.lit(1), F.col("half"))).alias("head"))
    heads = heads.groupBy(F.col("id").alias("p")).agg(F.min_by("head", F.when(F.col("head").isNotNull(), F.col("h"))).alias("head"))
    kept = F.substring("text", F.lit(1), (size - half).cast("int"))
    mine = F.substring(F.coalesce("head", F.lit("")), F.lit(1), half)
    both = rows.join(heads, "p", "left").select(
        "p", "doc_id", "h", "times", "text",
        F.concat(kept, F.when(F.col("doc_id").isNotNull(), mine).otherwise(F.lit(""))).alias("edited"))

    # What the result needs beside fingerprints rides along as the key of a third, one-word text.
    note = F.concat_ws(" ", size.cast("string"), F.col("times").cast("string"), F.col("doc_id").isNotNull().cast("string"), F.sha2("edited", 256))
    kind = lambda k, t, n: F.struct(F.lit(k).alias("kind"), t.alias("t"), n.alias("note"))
    none = F.lit(None).cast("string")
    kinds = F.explode(F.array(kind(0, F.col("text"), none), kind(1, F.col("edited"), none), kind(2, F.lit("-"), note)))
    signs = fingerprints(both.select("p", "h", kinds.alias("x")).select("p", "h", "x.kind", "x.note", "x.t"), ["p", "h", "kind", "note"], "t")
    blank = F.lit("")
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("fingerprint"))), blank)
    signs = signs.groupBy("p", "h").agg(F.split(F.max("note"), " ").alias("n"), of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    part = lambda i: F.get("n", F.lit(i))
    info = signs.select(
        "p", "h", F.when(part(2) == "true", F.col("p")).alias("doc_id"), part(1).cast("int").alias("times"), part(0).cast("long").alias("n_chars"),
        F.unhex(part(3)).alias("edited_sha256"), packed(F.col("fingerprint")).alias("fingerprint"), packed(F.col("edited_fingerprint")).alias("edited_fingerprint"))
    info = written(info, "cws-fingerprints")

    near = info.where("doc_id is not null").groupBy("p").agg(F.min_by("fingerprint", "h").alias("next_fingerprint"))
    near = near.join(asked.select("p", "id"), "p").select(F.col("id").alias("doc_id"), "next_fingerprint")
    one, edited, other = F.col("fingerprint"), F.col("edited_fingerprint"), F.coalesce("next_fingerprint", blank)
    plain = [unpacked(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")]
    both = info.join(near, "doc_id", "left").select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), *plain, "times")
    out = both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(one, edited).alias("near_edited"), likeness(one, other).alias("near_next"), "times")
    return out.select(*out.columns[:-1], F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("again")


def op8_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
