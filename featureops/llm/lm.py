"""Language-model scores from a weighted backoff automaton, asked for by chunks of texts.

All words of the training rows are known, and all n-grams that occur ``LEAST`` times in them are arcs, at every
corpus size. Probabilities use absolute discounting; what a state's arcs leave goes to its failure arc, which
leads to the state of the shorter history, and at the root to the smoothed count of the word. So the
probabilities that follow a state sum to one.

No task holds the model. Texts are read once into chunks of about ``CHUNK`` words, as places in a list of words. A chunk
then asks about each of its words and n-grams once, in sorted lists by part of the key space, and each part
answers all chunks: how often it occurs in all training rows, and which chunk is first to hold it. Trigrams are
asked only where both their bigrams are arcs, as they can be none elsewhere. The chunk that holds an arc first adds it to what the
arcs of its history sum up to; these sums are asked in the same way, and give the failure arcs. At last each chunk
has the part of the automaton that its texts can reach, and walks it: from a state by the arc of the next word, or else by
failure arcs to the states of shorter histories. Sums are of whole numbers, so neither order nor deal of rows matters.
A frequent word costs a list entry a chunk. Words and n-grams are known by 64-bit hashes.

Null and empty texts consist of the end token alone. Repeated rows are each scored, and each counted.
With no training row at all, base_score and score are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import remainder, scan, table, written
from featureops.llm.hashing import WORD_BASE, mixed, word_hashes

LEAST = 2
DISCOUNT = 0.75  # in quarters below, so that sums over arcs are whole numbers
HOLD_MOD = 10
ALPHA = 0.1  # in tenths below
END = mixed(np.array([ord("\n") + 1], "u8"))  # the hash of a line end, which no word contains
CHUNK = 1_500_000  # words, but for one longer text
PART = 500_000  # words of the table for each part of the key space
UNIT = float(1 << 36)
WORDS, BIGRAMS, TRIGRAMS, AFTER_WORDS, AFTER_BIGRAMS = range(1, 6)  # what is asked about


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair."""
    return mixed(a * WORD_BASE + mixed(b))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes, compressed: small numbers leave runs of zeros."""
    runs = values.astype("<u8").view("u1").reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(runs, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    runs = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(runs, "u1").reshape(8, n).T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(keys, prepend=np.zeros(1, "u8")))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype="u8")


def chunks(rows: DataFrame) -> DataFrame:
    """chunk, doc_id, held_out and words of each text (sizes), the words' hashes, and their places in these."""

    def make() -> Any:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        docs: list[tuple[Any, bool, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[dict[str, Any]]:
            nonlocal size
            if docs:
                words, places = np.unique(np.concatenate(held), return_inverse=True)
                ids, out_of, sizes = zip(*docs)
                yield {"chunk": [next(numbers)], "doc_id": [list(ids)], "held_out": [list(out_of)], "sizes": [list(sizes)], "words": [packed_keys(words)], "places": [packed(places)]}
            size = docs.clear() or held.clear() or 0

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal size
            if batch is None:
                yield from out()
                return
            for doc_id, out_of, text in zip(*batch.columns):
                row = word_hashes(text.as_py())[0]
                docs.append((doc_id.as_py(), out_of.as_py(), len(row)))
                held.append(row)
                size += len(row) + 1
                if size >= CHUNK:
                    yield from out()

        return step

    return scan(rows.select("doc_id", "held_out", "text"), make, "chunk long, doc_id array<bigint>, held_out array<boolean>, sizes array<int>, words binary, places binary")


class Chunk:
    """The tokens of a chunk's texts with their words (``word`` at each token), the words before them (``before``) and
    bigrams (``pair``), as places in sorted keys; and what was answered about these."""

    def __init__(self, held_out: np.ndarray, sizes: np.ndarray, words: bytes, places: bytes, told: dict[int, list[np.ndarray]]) -> None:
        self.told = told
        count = sizes + 1
        self.starts = np.cumsum(count) - count
        token = np.empty(count.sum(), "u8")
        ends = self.starts + sizes
        is_word = np.ones(len(token), bool)
        is_word[ends] = False
        token[is_word] = unpacked_keys(words)[unpacked(places).astype("i8")]
        token[ends] = END
        self.first = np.zeros(len(token), bool)
        self.first[self.starts] = True
        self.train = np.repeat(~held_out, count)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.before = np.concatenate([[0], self.word[:-1]])
        self.before[self.starts] = np.searchsorted(self.words, END[0])
        self.pairs, self.pair_at, self.pair = np.unique(linked(self.words[self.before], token), return_index=True, return_inverse=True)

    def times(self, place: np.ndarray, size: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(place[self.train[at]], minlength=size)

    def counted(self) -> None:
        """Takes the answers about words and bigrams."""
        self.n_words = self.told[WORDS][0] >> 1
        self.n_pairs, self.own = self.told[BIGRAMS][0] >> 1, (self.told[BIGRAMS][0] & 1) > 0
        self.arcs = self.n_pairs >= LEAST
        arc = self.arcs[self.pair]
        self.at = np.flatnonzero(~self.first & arc & np.concatenate([[False], arc[:-1]]))
        keys = linked(self.pairs[self.pair[self.at - 1]], self.pairs[self.pair[self.at]])
        self.triples, self.triple_at, self.triple = np.unique(keys, return_index=True, return_inverse=True)

    def n_triples(self) -> np.ndarray:
        return self.told[TRIGRAMS][0] >> 1

    def asks_grams(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        yield WORDS, self.words, [self.times(self.word, len(self.words))]
        yield BIGRAMS, self.pairs, [self.times(self.pair, len(self.pairs))]

    def asks_triples(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        self.counted()
        yield TRIGRAMS, self.triples, [self.times(self.triple, len(self.triples), self.at)]
        mine = np.flatnonzero(self.arcs & self.own)
        history, word = self.before[self.pair_at[mine]], self.word[self.pair_at[mine]]
        sums = [np.zeros(len(self.words), "i8") for _ in range(2)]
        np.add.at(sums[0], history, 4 * self.n_pairs[mine] - 3)
        np.add.at(sums[1], history, 10 * self.n_words[word] + 1)
        kept = self.n_words >= LEAST
        yield AFTER_WORDS, self.words[kept], [s[kept] for s in sums]

    def asks_after(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        self.counted()
        n = self.n_triples()
        mine = np.flatnonzero((n >= LEAST) & ((self.told[TRIGRAMS][0] & 1) > 0))
        at = self.at[self.triple_at[mine]]
        sums = [np.zeros(len(self.pairs), "i8") for _ in range(2)]
        np.add.at(sums[0], self.pair[at - 1], 4 * n[mine] - 3)
        np.add.at(sums[1], self.pair[at - 1], 4 * self.n_pairs[self.pair[at]] - 3)
        yield AFTER_BIGRAMS, self.pairs[self.arcs], [s[self.arcs] for s in sums]

    def scores(self, total: int, distinct: int) -> dict[str, np.ndarray]:
        """By text: tokens known, base score and score (multiples of 1 / UNIT)."""
        self.counted()
        whole = total + ALPHA * (distinct + 1)
        known = np.maximum(self.n_words, 1)
        left = lambda part: np.maximum(1e-12, 1 - part)

        def failure(kind: int, of: np.ndarray, times: np.ndarray, below: np.ndarray | float) -> np.ndarray:
            """Weights of the failure arcs of the states ``of``; 0 where no arc leaves a state."""
            out = np.zeros(len(of))
            own, lower = self.told[kind]
            out[of] = np.where(own > 0, np.log10(left(own / (4 * times)) / left(lower / below)), 0.0)
            return out

        some = self.n_words >= LEAST
        back_1 = failure(AFTER_WORDS, some, self.n_words[some], 10 * whole)
        back_2 = failure(AFTER_BIGRAMS, self.arcs, self.n_pairs[self.arcs], 4 * known[self.word[self.pair_at[self.arcs]]])
        base = np.log10((self.n_words + ALPHA) / whole)[self.word]
        pairs = np.log10((np.maximum(self.n_pairs, 1) - DISCOUNT) / known[self.before[self.pair_at]])
        score = np.where(self.arcs[self.pair], pairs[self.pair], back_1[self.before] + base)
        behind = np.concatenate([[0], self.pair[:-1]])  # the bigram before, the state
        score = np.where(self.first, score, back_2[behind] + score)
        n = self.n_triples()[self.triple]
        arc = n >= LEAST
        at = self.at[arc]
        score[at] = np.log10((n[arc] - DISCOUNT) / self.n_pairs[behind[at]])
        summed = lambda x: np.add.reduceat(x, self.starts)
        number = lambda x: summed(np.round(x * UNIT).astype("i8")) / UNIT
        return {"n_known": summed((self.n_words[self.word] > 0).astype("i8")), "base_score": number(base), "score": number(score)}


def each(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, Any], Chunk]]:
    """A batch's chunks."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        told: dict[int, list[np.ndarray]] = {}
        lists: dict[int, list[Any]] = {}
        for t in (row["told"].as_py() if "told" in row else None) or ():
            lists.setdefault(t["kind"], []).append((t["part"], t["data"], t["more"]))
        for kind in range(WORDS, AFTER_BIGRAMS + 1):
            parts = sorted(lists.get(kind, ()), key=lambda x: x[0])
            told[kind] = [np.concatenate([np.zeros(0, "i8"), *(unpacked(p[k]).view("i8") for p in parts if p[k] is not None)]) for k in (1, 2)]
        array = lambda c: row[c].values.to_numpy(zero_copy_only=False)
        yield row, Chunk(array("held_out").astype(bool), array("sizes").astype("i8"), row["words"].as_py(), row["places"].as_py(), told)


def answered(made: DataFrame, told: DataFrame | None, asks: Callable[[Chunk], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]], bits: int, name: str) -> DataFrame:
    """chunk, part, kind, data, more: to each list that a chunk asks about, the numbers summed up over all chunks, in its
    order; and ``known``, how many of a part's keys occur at all."""

    def make() -> Any:
        edges = np.arange(1, 1 << bits, dtype="u8") << np.uint64(64 - bits) if bits else np.zeros(0, "u8")

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            for row, chunk in each(batch) if batch is not None else ():
                for kind, keys, numbers in asks(chunk):
                    cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                    parts = [(p, lo, hi) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                    yield {
                        "chunk": [row["chunk"].as_py()] * len(parts), "part": [p for p, _, _ in parts], "kind": [kind] * len(parts), "keys": [packed_keys(keys[lo:hi]) for _, lo, hi in parts],
                        **{c: [packed(numbers[k][lo:hi]) if k < len(numbers) else None for _, lo, hi in parts] for k, c in enumerate(("data", "more"))}}

        return step

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("chunk", ignore_index=True)
        lists = [unpacked_keys(k) for k in asked["keys"]]
        cuts = np.cumsum([len(k) for k in lists])[:-1]
        keys, at, place = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        first = np.zeros(len(place), "i8")
        first[at] = 1
        out = {}
        known = 0
        for c in ("data", "more"):
            out[c] = [None] * len(asked)
            if asked[c].notna().all():
                total = np.zeros(len(keys), "i8")
                np.add.at(total, place, np.concatenate([unpacked(x).view("i8") for x in asked[c]]))
                own = asked["kind"].iloc[0] <= TRIGRAMS
                known = int((total > 0).sum()) if own else 0
                out[c] = [packed(x) for x in np.split(total[place] * 2 + first if own else total[place], cuts)]
        return asked[["chunk", "part", "kind"]].assign(**out, known=[known] + [0] * (len(asked) - 1))

    asked = scan(with_told(made, told), make, "chunk long, part int, kind int, keys binary, data binary, more binary")
    return written(asked.groupBy("part", "kind").applyInPandas(answer, "chunk long, part int, kind int, data binary, more binary, known long"), name)


def with_told(made: DataFrame, told: DataFrame | None) -> DataFrame:
    """Chunks with all that was answered to them."""
    if told is None:
        return made
    return made.join(told.groupBy("chunk").agg(F.collect_list(F.struct("part", "kind", "data", "more")).alias("told")), "chunk")


def scored(docs: DataFrame, hold_mod: int = HOLD_MOD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(hold_mod) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    made = written(chunks(rows), "lm-chunks")
    tokens = lambda which: F.coalesce(F.sum(F.aggregate(F.arrays_zip("held_out", "sizes"), F.lit(0).cast("long"), lambda n, d: n + F.when(which(d), d["sizes"] + 1).otherwise(0))), F.lit(0))
    every, total = made.agg(tokens(lambda d: F.lit(True)), tokens(lambda d: ~d["held_out"])).first()
    bits = max(0, (every // PART).bit_length())
    told = answered(made, None, Chunk.asks_grams, bits, "lm-counts")
    distinct = told.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    told = told.union(answered(made, told, Chunk.asks_triples, bits, "lm-trigrams"))
    told = told.union(answered(made, told, Chunk.asks_after, bits, "lm-failures"))

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            for row, chunk in each(batch) if batch is not None else ():
                out = chunk.scores(total, distinct)
                if not total:
                    out |= {c: [None] * len(chunk.starts) for c in ("base_score", "score")}
                sizes = row["sizes"].values.to_numpy(zero_copy_only=False)
                yield {"doc_id": row["doc_id"].values, "held_out": row["held_out"].values, "n_tokens": sizes.astype("i8") + 1, "train_tokens": np.full(len(sizes), total)} | out

        return step

    return scan(with_told(made, told), make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
