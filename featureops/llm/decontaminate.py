"""Benchmark decontamination by latent semantic retrieval.

1. Passages are runs of 48 words; they are described by TF-IDF over the benchmark's words. Document
   frequencies come from all passages of all documents. Words in more than ``COMMON`` of the passages are left
   out, but for items that would keep fewer than ``FEW`` words.
2. The term space is reduced by a randomised SVD in one distributed pass: with A the TF-IDF rows of all passages
   and of the benchmark (weighed to have the same sum), each task adds up its part of A^T (A O) for a random
   matrix O, the parts are summed by term, and the leading right singular vectors follow from the sum
   (Nystrom's form). Its size is bounded by the words of a block of ``ITEM_BLOCK`` items; a larger benchmark is
   worked off block by block.
3. Every passage, at every 16th word, is projected and compared by cosine with all items, block against block;
   items of at most ``SHORT`` words also with passages of 32 words.
   A pair over ``COSINE`` is checked in the text around it: the longest common subsequence with the item, as a
   share of the item's words, must reach ``SURE``, or ``LIKELY`` with as much as ``SURE`` of the answer
   (the item's last sentence; of a single sentence, its last third).

Null and empty texts, and items without words, match nothing. A row comes for each document row and item; rows
without doc_id are searched too and returned with a null id; items that repeat are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import scan, table, texts, words, written

PASSAGE, STRIDE = 48, 16
UNITS = PASSAGE // STRIDE
SHORT, SHORT_UNITS = 24, 2  # items of so few words are compared with shorter passages, too
RANK, EXTRA = 128, 16
COMMON, FEW = 0.02, 6
COSINE = 0.4
SURE, LIKELY = 0.75, 0.5
ITEM_BLOCK = 2_000
PART = 500_000  # words of texts held at once
BLOCK = 4_096  # passages compared at once
PRODUCT = 30_000  # values multiplied at once


class Items:
    """A block of benchmark items: their words as terms, which are numbers in the vocabulary of all of them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        kept = [(i, t, row) for i, t in rows if (row := words(t))]
        self.ids = [i for i, _, _ in kept]
        self.term_of = {w: k for k, w in enumerate(sorted({w for _, _, row in kept for w in row}))}
        self.terms = [np.array([self.term_of[w] for w in row], "i4") for _, _, row in kept]
        self.answers = [answer_of(t, row) for (_, t, _), row in zip(kept, self.terms)]
        self.size = len(self.term_of)
        self.sets = [frozenset(t.tolist()) for t in self.terms]
        self.masks = [places_of(t) for t in self.terms]
        # A common subsequence has at most as many words as terms are shared, and the item's repeated words.
        self.shared = [int(np.ceil(LIKELY * len(t))) - (len(t) - len(u)) for t, u in zip(self.terms, self.sets)]


def answer_of(text: str, terms: np.ndarray) -> np.ndarray:
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.split()]
    n = len(parts[-1].encode().split()) if len(parts) > 1 else max(1, len(terms) // 3)
    return terms[-n:]


def places_of(a: np.ndarray) -> dict[int, int]:
    """Where each term stands in a, a bit for each word."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_length(a: np.ndarray, b: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit for each word of a; ``masks`` are a's places, if known."""
    get = (places_of(a) if masks is None else masks).get
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def coded(docs: DataFrame, items: Any) -> DataFrame:
    """doc_id, n_words, at, terms: where the vocabulary's words stand in each text. Other words match no item."""

    def make() -> Any:
        get = items.value.term_of.get

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            out: dict[str, Any] = {"doc_id": batch.column(0), "n_words": [], "at": [], "terms": []}
            for value in batch.column(1):
                row = words(value.as_py())
                ids = np.array([get(w, -1) for w in row], "i4")
                at = np.flatnonzero(ids >= 0)
                out["n_words"].append(len(row))
                out["at"].append(at.astype("i4").tobytes())
                out["terms"].append(ids[at].tobytes())
            yield out

        return step

    return scan(docs.select("doc_id", "text"), make, "doc_id long, n_words long, at binary, terms binary")


def stream(batch: pa.RecordBatch, first: int, unit: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's coded rows from column ``first`` on: all terms, their units of ``unit`` words, numbered
    through with ``gap`` empty ones after each row, and each row's first unit (one more for the end)."""
    sizes = batch.column(first).to_numpy()
    starts = np.concatenate([[0], np.cumsum(-(-sizes // unit) + gap)])
    rows = batch.column(first + 1).to_pylist()
    at = np.frombuffer(b"".join(rows), "i4")
    terms = np.frombuffer(b"".join(batch.column(first + 2).to_pylist()), "i4")
    return terms.astype("i8"), np.repeat(starts[:-1], [len(r) // 4 for r in rows]) + at // unit, starts


def in_parts(make: Any, column: int) -> Any:
    """Gives batches on in runs of rows with some ``PART`` words, which ``column`` tells, so that a task's memory
    doesn't follow the size of batches. A longer text is a run of its own."""

    def made() -> Any:
        step = make()

        def parts(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                yield from step(None)
                return
            total = np.cumsum(batch.column(column).to_numpy())
            at = 0
            while at < len(total):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART, "right")))
                yield from step(batch.slice(at, to - at))
                at = to

        return parts

    return made


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[at], np.diff(at, append=len(keys))


def unit_place(batch: pa.RecordBatch, first_unit: np.ndarray) -> np.ndarray:
    """Of a batch of doc_id, n_words, at, terms: the place of each term, counted as units of ``STRIDE`` are."""
    rows = batch.column(2).to_pylist()
    return np.frombuffer(b"".join(rows), "i4") + np.repeat(first_unit[:-1] * STRIDE, [len(r) // 4 for r in rows])


def frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Number of passages with each term, over all documents, and of passages."""

    def make() -> Any:
        total = np.zeros(size + 1, "i8")  # the last counts passages

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal total
            if batch is None:
                some = np.flatnonzero(total)
                yield {"term": some, "n": total[some]}
                return
            terms, group, starts = stream(batch, 0, PASSAGE, 0)
            total += np.bincount(runs(group * size + terms)[0] % size, minlength=size + 1)
            total[size] += starts[-1]

        return step

    got = scan(rows.select("n_words", "at", "terms"), in_parts(make, 0), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, "i8")
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out[:-1], int(out[-1])


def term_weights(items: Items, df: np.ndarray, passages: int) -> np.ndarray:
    """IDF; 0 for words that are too common to tell."""
    keep = df <= COMMON * passages
    for terms in items.terms:
        if keep[np.unique(terms)].sum() < FEW:
            keep[terms] = True
    return np.where(keep, np.log((1 + passages) / (1 + df)), 0.0).astype("f4")


def rows_of(group: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of unit length: (row number, term, value), rows numbered from 0 by group."""
    size = len(weights)
    keys, count = runs(group * size + terms)
    row, term = np.divmod(keys, size)
    value = count * weights[term]
    row = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    norm = np.sqrt(np.bincount(row, value * value)) if len(row) else np.zeros(0)
    return row, term, (value / np.maximum(norm[row], 1e-12)).astype("f4")


def add_product(total: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], omega: np.ndarray) -> None:
    """total += R^T (R omega) for sparse rows R."""
    row, term, value = rows
    if not len(row):
        return
    part = omega[term] * value[:, None]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    image = np.add.reduceat(part, starts, 0)
    order = np.argsort(term, kind="stable")
    back = image[row[order]] * value[order, None]
    first = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) != 0]))
    total[term[order][first]] += np.add.reduceat(back, first, 0)


def range_sketch(rows: DataFrame, weights: np.ndarray, omega: Any) -> np.ndarray:
    """A^T (A omega) over all passages: partial sums by task, then by term."""
    width = omega.value.shape[1]

    def make() -> Any:
        draw = omega.value
        total = np.zeros(draw.shape, "f4")

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                some = np.flatnonzero(total.any(1))
                yield {"term": some, "part": [r.tobytes() for r in total[some]]}
                return
            terms, group, _ = stream(batch, 0, PASSAGE, 0)
            keep = weights[terms] > 0
            row, term, value = rows_of(group[keep], terms[keep], weights)
            at = 0
            while at < len(row):  # whole rows, some ten thousand values at once
                to = int(np.searchsorted(row, row[min(at + PRODUCT, len(row) - 1)], "right"))
                add_product(total, (row[at:to] - row[at], term[at:to], value[at:to]), draw)
                at = to

        return step

    def add() -> Any:
        sums: dict[int, np.ndarray] = {}

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                yield {"term": list(sums), "part": [v.tobytes() for v in sums.values()]}
                return
            for term, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(part, "f4" if len(part) == 4 * width else "f8").astype("f8")
                sums[term] = sums[term] + row if term in sums else row

        return step

    parts = scan(rows.select("n_words", "at", "terms"), in_parts(make, 0), "term int, part binary")
    got = scan(parts.repartition("term"), add, "term int, part binary").toArrow()
    out = np.zeros(omega.value.shape)
    for term, part in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[term] = np.frombuffer(part, "f8")
    return out


def latent_space(rows: DataFrame, known: Items, weights: np.ndarray, passages: int) -> np.ndarray:
    """Leading right singular vectors (term, direction) of passages and benchmark together."""
    size = len(weights)
    g = np.random.default_rng(2)
    draw = g.standard_normal((size, min(size, RANK + EXTRA))).astype("f4")
    omega = rows.sparkSession.sparkContext.broadcast(draw)
    sketch = range_sketch(rows, weights, omega)
    own = np.zeros(draw.shape, "f4")
    add_product(own, rows_of(np.repeat(np.arange(len(known.terms)), [len(t) for t in known.terms]), np.concatenate(known.terms).astype("i8"), weights), draw)
    sketch += own * max(1.0, passages / len(known.terms))
    # A^T A is near sketch core^+ sketch^T with core = omega^T sketch
    core = draw.T.astype("f8") @ sketch
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > value.max() * 1e-10
    half = sketch @ (vector[:, ok] / np.sqrt(value[ok]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :RANK]


def matches(rows: DataFrame, items: Any, embed: Any) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer of the pairs that pass the checks."""

    def make() -> Any:
        known, e = items.value, embed.value
        used = e.any(1)
        each = np.stack([e[t].sum(0) for t in known.terms])
        size = np.linalg.norm(each, axis=1, keepdims=True)
        each = np.ascontiguousarray((each / np.maximum(size, 1e-12)).T)
        length = np.array([len(t) for t in known.terms])
        short = np.flatnonzero(length <= SHORT)
        kinds = [(UNITS, np.arange(len(known.terms)), each), (SHORT_UNITS, short, np.ascontiguousarray(each[:, short]))]

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            # empty units keep the passages within their document
            terms, unit, first_unit = stream(batch, 1, STRIDE, UNITS - 1)
            keep = used[terms]
            term, unit = terms[keep], unit[keep]
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            # words are numbered through as units are
            place = unit_place(batch, first_unit)
            # a passage begins at each unit up to two before one that has a word of the vocabulary
            busy = runs(unit)[0]
            start = runs((busy[:, None] - np.arange(UNITS)).ravel())[0]
            start = start[start >= 0]
            for low in range(0, len(start), BLOCK):
                part = start[low : low + BLOCK]
                a, b = np.searchsorted(unit, [part[0], part[-1] + UNITS])
                span = int(part[-1] + UNITS - part[0])
                sums = np.zeros((span, e.shape[1]), "f4")
                if a < b:
                    edge = np.flatnonzero(np.concatenate([[True], unit[a + 1 : b] != unit[a : b - 1]]))
                    sums[unit[a:b][edge] - part[0]] = np.add.reduceat(e[term[a:b]], edge, 0)
                pairs: dict[tuple[int, int], float] = {}
                for units, which, those in kinds:
                    passages = sum(sums[part - part[0] + k] for k in range(units))
                    norm = np.maximum(np.linalg.norm(passages, axis=1), 1e-9)
                    near = passages @ those
                    for p, i in np.argwhere(near >= COSINE * norm[:, None]).tolist():
                        pairs[p, int(which[i])] = max(pairs.get((p, int(which[i])), 0.0), float(near[p, i] / norm[p]))
                if not pairs:
                    continue
                p, i = np.array(list(pairs), "i8").T
                d = np.searchsorted(first_unit, part[p], "right") - 1
                begin, more = part[p] * STRIDE, STRIDE + np.maximum(0, length[i] - PASSAGE)
                from_, to = (np.searchsorted(place, np.clip(x, first_unit[d] * STRIDE, first_unit[d + 1] * STRIDE)) for x in (begin - more, begin + PASSAGE + more))
                seen: dict[tuple[int, int], set[int]] = {}
                for doc, j, x, y, cosine in zip(d.tolist(), i.tolist(), from_.tolist(), to.tolist(), pairs.values()):
                    around = seen.get((x, y))
                    if around is None:
                        around = seen[x, y] = set(terms[x:y].tolist())
                    if len(known.sets[j] & around) < known.shared[j]:
                        continue
                    item = known.terms[j]
                    lcs = common_length(item, terms[x:y], known.masks[j]) / len(item)
                    if lcs < LIKELY:
                        continue
                    answer = known.answers[j]
                    told = common_length(answer, terms[x:y]) / len(answer)
                    if lcs >= SURE or told >= SURE:
                        found = (lcs, told, cosine)
                        best[doc, j] = max(best.get((doc, j), found), found)
            yield {
                "doc_id": batch.column(0).take(pa.array([d for d, _ in best], pa.int64())), "item_id": [known.ids[i] for _, i in best],
                "cosine": [v[2] for v in best.values()], "lcs": [v[0] for v in best.values()], "answer": [v[1] for v in best.values()],
            }

        return step

    return scan(rows.select("doc_id", "n_words", "at", "terms"), in_parts(make, 1), "doc_id long, item_id long, cosine double, lcs double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row and leaked item: doc_id, item_id, cosine, lcs, answer."""
    spark = docs.sparkSession
    docs = texts(docs)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-named.count() // ITEM_BLOCK))
    out: DataFrame | None = None
    for block in range(blocks):
        some = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        known = Items([tuple(r) for r in some])
        if not known.size:
            continue
        items = spark.sparkContext.broadcast(known)
        rows = written(coded(docs, items), "leaks-coded")
        df, passages = frequencies(rows, known.size)
        weights = term_weights(known, df, passages)
        vectors = latent_space(rows, known, weights, passages)
        embed = spark.sparkContext.broadcast((vectors * weights[:, None]).astype("f4"))
        one = matches(rows, items, embed)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double")


def op6_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
