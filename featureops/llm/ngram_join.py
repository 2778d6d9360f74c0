"""Jaccard join on word n-grams with Bayesian pruning of candidates.

1. Every text becomes its set of hashed five-word shingles (a shorter text is one shingle), a digest of the
   set, and 80 MinHash values. Texts with one set are copies; one of each goes on, with the number of copies.
2. The values are cut into 20 bands of four. Rows that share a band meet in cells; a busy band key is cut
   into blocks of rows, and a cell holds two blocks. In a cell the MinHash values of each pair are compared
   16 at a time: with m of n equal and a uniform prior, the similarity has a Beta(m + 1, n - m + 1)
   distribution, and a pair goes as soon as P(similarity >= threshold) falls below the tolerance. What is left
   is kept as a spanning forest of the cell, so the output grows with the rows, not with the pairs.
3. The connected candidates are verified exactly: the shingle sets of a component meet, in cells again,
   and a cell counts the shared shingles of all its pairs by one matrix product. It returns each row's number
   of links and a spanning forest of the links.

A pair of similarity 0.8 is missed by the bands with a probability of 3e-5, and by the pruning with less
than 1e-4; above 0.85 both are below 1e-7.

Null texts are empty; empty texts are copies of each other. Repeated rows are copies. A row without doc_id
counts as a copy and gets its row, but names no class; a class of such rows alone has no class_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import components, scan, table, texts, written
from featureops.llm.hashing import mixed, sequence_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
STEP = 16  # MinHash values compared before the next look at the posterior
TOLERANCE = 1e-5
BLOCK = 256  # rows of a side of a cell


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's runs of ``size`` words, in order."""
    hashes, _, _ = word_hashes(text)
    return np.unique(sequence_hashes(hashes, min(size, max(1, len(hashes)))))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """High halves of the least products with each odd factor."""
    least = np.full(len(_FACTORS), np.iinfo("u8").max, "u8")
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * _FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype("u4")


def least_matches(threshold: float, tolerance: float, step: int, total: int) -> list[tuple[int, int]]:
    """(n, fewest matches among n values with which a pair stays), after each step."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            log_p = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log_p - log_p.max())
            if p[grid >= threshold].sum() >= tolerance * p.sum():
                out.append((n, m))
                break
    return out


class Forest:
    """Union of rows of a cell; the links that joined two parts are its edges."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def cells(rows: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Rows with their cells: ``x`` <= ``y`` name the two blocks, ``mine`` the row's own. ``size`` is the
    number of rows of its key; a key of up to BLOCK rows is one cell."""
    g = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(9)), g).cast("int")
    out = rows.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    out = out.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("other")
    return out.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y")


def by_cell(df: DataFrame, work: Callable[[list[pa.RecordBatch]], dict[str, Any] | None], schema: str, keys: int = 3) -> DataFrame:
    """``work`` on the rows of each cell; the first ``keys`` columns name it and the rows come in order."""

    def make() -> Any:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done() -> Iterator[dict[str, Any]]:
            if held and (out := work(held)) is not None:
                yield out

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal held, last
            if batch is None:
                yield from done()
                return
            names = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
            parts: dict[str, list] = {}
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != last:
                    for out in done():
                        for c, v in out.items():
                            parts.setdefault(c, []).extend(v)
                    held, last = [], names[at]
                held.append(batch.slice(at, to - at))
                at = to
            if parts:
                yield parts

        return step

    return scan(df, make, schema)


def column(held: list[pa.RecordBatch], i: int) -> list:
    return [v for b in held for v in b.column(i).to_pylist()]


def candidate_forest(held: list[pa.RecordBatch]) -> dict[str, Any] | None:
    """Columns: key, x, y, mine, band, set_id, values. A pair is judged in the first band that it shares."""
    if sum(len(b) for b in held) < 2:
        return None
    mine, ids = np.array(column(held, 3)), column(held, 5)
    x, y, band = held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py(), held[0].column(4)[0].as_py()
    values = np.frombuffer(b"".join(column(held, 6)), "u4").reshape(len(ids), -1)
    left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
    forest = Forest(len(ids))
    for i in left:
        j = right[right > i] if x == y else right
        if not len(j):
            continue
        same = values[i] == values[j]
        if band:
            j = j[~same[:, : band * ROWS].reshape(len(j), band, ROWS).all(2).any(1)]
            if not len(j):
                continue
            same = values[i] == values[j]
        for n, m in _LEAST:
            stay = same[:, :n].sum(1) >= m
            j, same = j[stay], same[stay]
            if not len(j):
                break
        for k in j.tolist():
            forest.link(int(i), k)
    return {"a": [ids[i] for i, _ in forest.edges], "b": [ids[j] for _, j in forest.edges]} if forest.edges else None


_LEAST = least_matches(THRESHOLD, TOLERANCE, STEP, BANDS * ROWS)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the shingles that two sets have."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    row, col = row[keep], number[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, width = np.zeros((n, n), "f4"), max(1, 4_000_000 // n)
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, [low, low + width])
        part = np.zeros((n, min(width, int(often.sum()) - low)), "f4")
        part[row[a:b], col[a:b] - low] = 1
        out += part @ part.T
    return out


def verified(held: list[pa.RecordBatch]) -> dict[str, Any] | None:
    """Columns: root, x, y, mine, set_id, copies, shingles. Rows (a, b, links): b is null where links are counted."""
    ids, mine = column(held, 4), np.array(column(held, 3))
    if len(ids) < 2:
        return None
    x, y = held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py()
    copies = np.array(column(held, 5))
    sets = [np.frombuffer(s, "u8") for s in column(held, 6)]
    size = np.array([len(s) for s in sets], "f8")
    both = shared(sets)
    linked = 9 * both.astype("f8") >= 4 * (size[:, None] + size[None, :])  # shared / union >= 0.8
    np.fill_diagonal(linked, False)
    if x != y:  # pairs within a block belong to the cell of that block with itself
        linked &= mine[:, None] != mine[None, :]
    links = linked @ copies
    forest = Forest(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(linked[i, i + 1 :]).tolist():
            forest.link(i, i + 1 + j)
    counted = np.flatnonzero(links).tolist()
    return {
        "a": [ids[i] for i in counted] + [ids[i] for i, _ in forest.edges],
        "b": [None] * len(counted) + [ids[j] for _, j in forest.edges],
        "links": links[counted].tolist() + [0] * len(forest.edges),
    }


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, set_id, values of every row."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            ids, values = [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                ids.append(set_digest(shingles))
                values.append(min_hashes(shingles).tobytes())
            yield {"doc_id": batch.column(0), "set_id": ids, "values": values}

        return step

    return scan(texts(docs), make, "doc_id long, set_id binary, values binary")


def banded(sets: DataFrame) -> DataFrame:
    """key, band, set_id: one row for each band of each set."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            n = len(batch)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u4").reshape(n, BANDS, ROWS).astype("u8")
            keys = np.zeros((n, BANDS), "u8") + np.arange(BANDS, dtype="u8")
            for r in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
            yield {"key": keys.view("i8").ravel(), "band": np.tile(np.arange(BANDS, dtype="i4"), n), "set_id": batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))}

        return step

    return scan(sets.select("set_id", "values"), make, "key long, band int, set_id binary")


def shingled(rows: DataFrame) -> DataFrame:
    """Columns set_id, root, size, copies, text: the text's shingles in place of it, where its digest is set_id."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            sets = [shingle_set(t.as_py()) for t in batch.column(4)]
            right = [i for i, (s, d) in enumerate(zip(sets, batch.column(0).to_pylist())) if set_digest(s) == d]
            kept = batch.take(pa.array(right, pa.int64()))
            yield {c: kept.column(i) for i, c in enumerate(("set_id", "root", "size", "copies"))} | {"shingles": [sets[i].tobytes() for i in right]}

        return step

    return scan(rows, make, "set_id binary, root binary, size long, copies long, shingles binary")


def joined(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id connected by links), n_links (rows with similarity 0.8 or more, copies
    among them, itself not), n_copies (other rows with its shingle set)."""
    rows = written(signed(docs), "join-signed")
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("values").alias("values"))
    sets = written(sets, "join-sets")

    bands = written(banded(sets), "join-bands")
    busy = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = bands.join(busy, "key").join(sets.select("set_id", "values"), "set_id").select("key", "size", "band", "set_id", "values")
    met = cells(met, "key", "size", "set_id").select("key", "x", "y", "mine", "band", "set_id", "values")
    near = components(by_cell(met, candidate_forest, "a binary, b binary"), "join-near")

    near = written(near.withColumnRenamed("node", "set_id").join(sets.select("set_id", "first", "copies"), "set_id"), "join-candidates")
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    wanted = near.join(sizes, "root").select("set_id", "root", "size", "copies", F.col("first").alias("doc_id"))
    named = wanted.select(*(F.col(c) for c in wanted.columns if c != "doc_id"), F.col("doc_id").alias("first"))
    # a merge join at every size: the candidates grow with the documents
    full = named.join(texts(docs).hint("merge"), F.col("first").eqNullSafe(F.col("doc_id")))
    full = shingled(full.select("set_id", "root", "size", "copies", "text")).dropDuplicates(["set_id"])
    full = cells(full, "root", "size", "set_id").select("root", "x", "y", "mine", "set_id", "copies", "shingles")
    judged = written(by_cell(full, verified, "a binary, b binary, links long"), "join-judged")

    links = judged.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    groups = components(judged.where("b is not null").select("a", "b"), "join-classes").withColumnRenamed("node", "set_id")
    heads = groups.join(sets.select("set_id", "first"), "set_id").groupBy("root").agg(F.min("first").alias("head"))
    linked = groups.join(heads, "root").join(links, "set_id").select("set_id", "head", "links")
    known = sets.where("copies > 1").select("set_id", "first", "copies").join(linked, "set_id", "full").select(
        "set_id", F.coalesce("head", "first").alias("head"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = rows.select("doc_id", "set_id").join(known, "set_id", "left")
    more = F.coalesce("copies", F.lit(1)) - 1
    return out.select("doc_id", F.coalesce("head", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + more).cast("long").alias("n_links"), more.cast("long").alias("n_copies"))


def op1_ngram_bayes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
