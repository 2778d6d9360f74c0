"""Alignment of two tokenizers' tokens over each text, with corpus-wide counts of linked ids.

Both token streams cover the same bytes. In each batch ``pandas.merge_asof``, keyed by document, finds for every
token start the other side's token that covers it; the union of both directions is the set of overlapping pairs.
Byte offsets where tokens of both sides end cut the streams into groups.

How many documents hold an id pair is counted over all rows. Documents are gathered in chunks of bounded size
that list each pair once: lists are exploded, added up, joined with their totals and sent back, while
the documents keep short references into their chunk's list. So a pair that most documents hold costs one row a
chunk, not one a document, and no list is longer than its chunk.

Null and empty texts, and texts whose tokens don't give back a space and the text byte by byte, have no tokens:
zeros and an empty digest. Special tokens' strings are plain text. Each row is a document of its own, repeated
rows and rows without doc_id too. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.bpe import PATTERN, byte_signs
from featureops.llm.common import scan, table, texts, written

BATCH_BYTES = 1 << 20  # text aligned at once
CHUNK_BYTES = 8 << 20  # text of the documents that share a list of pairs


def public_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level_encoder(source: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder of a byte-level vocabulary file (its JSON text), special tokens being plain text, and the bytes of its tokens.

    Where ids follow the order of the merges, as usual, merging by rank is merging by id, which a rank table does
    several times faster with the same ids; other files go through the library they are made for."""
    import tiktoken
    from tokenizers import Tokenizer

    spec, signs = json.loads(source), byte_signs()
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in [*vocab.items(), *special.items()]:
        tokens[i] = token.encode() if token in special else bytes(signs[c] for c in token)
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if all(x < y for x, y in zip(made, made[1:])):
        ranks = {tokens[i]: i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, tokens
    plain = Tokenizer.from_str(source)
    plain.no_truncation()
    plain.no_padding()
    plain.encode_special_tokens = True
    return lambda text: plain.encode(text, add_special_tokens=False).ids, tokens


class Sides:
    """Both tokenizers (from their files' contents), the bytes of their tokens and the tables that follow from them."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        import sentencepiece

        self.a_ids, self.a_bytes = byte_level_encoder(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, t))) for t in (self.a_bytes, self.b_bytes))
        # an id and what follows it: "," inside a group, "|" after its A side, ";" after its B side
        self.signs = [b"%d%b" % (i, s) for ids, close in ((self.a_bytes, b"|"), (self.b_bytes, b";")) for i in range(len(ids)) for s in (b",", close)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where they don't cover a space and the text."""
        if not text:
            return None
        whole = f" {text}".encode()
        a, b = np.array(self.a_ids(f" {text}"), np.int64), self.b.encode(text)
        # the byte-level side cuts the text's own bytes, so that a shorter sum is the only way to differ
        if self.a_size[a].sum() != len(whole) or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return a, np.array(b, np.int64)


_SIDES: dict[int, Sides] = {}


def sides_of(sources: tuple[str, bytes]) -> Sides:
    key = hash(sources)
    if key not in _SIDES:
        _SIDES.clear()
        _SIDES[key] = Sides(*sources)
    return _SIDES[key]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(doc, a, b) for all tokens of ``a`` (doc, start, a) and ``b`` (doc, start, b) whose bytes overlap; starts ascend."""
    a, b = a.assign(a_start=a["start"]), b.assign(b_start=b["start"])
    forth = pd.merge_asof(a, b, on="start", by="doc")
    back = pd.merge_asof(b, a, on="start", by="doc")
    return pd.concat([forth, back[back["a_start"] != back["b_start"]]])[["doc", "a", "b"]]


def aligned(sides: Sides, batch: list[str]) -> tuple[list[dict[str, Any]], np.ndarray, np.ndarray, np.ndarray]:
    """Per text its numbers and digest; and per distinct pair of a text: the text's place, the pair, how often it is linked."""
    found = [sides.tokens(t) for t in batch]
    docs = [dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="") for _ in batch]
    full = [i for i, f in enumerate(found) if f is not None]
    if not full:
        return docs, *(np.zeros(0, np.int64),) * 3
    ids, size, doc, end, last = {}, {}, {}, {}, {}
    for side, sizes in ((0, sides.a_size), (1, sides.b_size)):
        count = np.array([len(found[i][side]) for i in full])
        ids[side] = np.concatenate([found[i][side] for i in full])
        size[side] = sizes[ids[side]]
        doc[side] = np.repeat(np.array(full), count)
        end[side] = np.cumsum(size[side])
        last[side] = np.concatenate([[0], np.cumsum(count)])
    frame = lambda side, name: pd.DataFrame({"doc": doc[side], "start": end[side] - size[side], name: ids[side]})
    links = overlaps(frame(0, "a"), frame(1, "b"))

    closes = {0: np.isin(end[0], end[1]), 1: np.isin(end[1], end[0])}
    group = {s: np.cumsum(c) - c for s, c in closes.items()}
    before = {s: np.concatenate([[0], np.cumsum(np.bincount(g))]) for s, g in group.items()}
    codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    codes[np.arange(len(ids[0])) + before[1][group[0]]] = ids[0] * 2 + closes[0]
    codes[np.arange(len(ids[1])) + before[0][group[1] + 1]] = (ids[1] + len(sides.a_bytes)) * 2 + closes[1]
    n_links = np.bincount(links["doc"], minlength=len(batch))
    n_groups = np.bincount(doc[0], closes[0], minlength=len(batch)).astype(int)
    for k, i in enumerate(full):
        (a0, a1), (b0, b1) = (last[s][k : k + 2] for s in (0, 1))
        line = b"".join(map(sides.signs.__getitem__, codes[a0 + b0 : a1 + b1].tolist()))[:-1]
        docs[i] = dict(n_a=int(a1 - a0), n_b=int(b1 - b0), n_groups=int(n_groups[i]), n_links=int(n_links[i]), groups_sha256=hashlib.sha256(line).hexdigest())
    every = len(sides.a_bytes) * len(sides.b_bytes)
    pair = links["a"].to_numpy() * len(sides.b_bytes) + links["b"].to_numpy()
    keys, times = np.unique(links["doc"].to_numpy() * every + pair, return_counts=True)
    return docs, keys // every, keys % every, times


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, the low ones first: small numbers leave runs of zeros."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
FACTS = [f.split()[0] for f in DOC.split(", ")]


class Chunk:
    """Documents that share a list of pairs."""

    def __init__(self) -> None:
        self.docs: list[dict[str, Any]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, sides: Sides, doc_ids: list[int | None], batch: list[str], size: int) -> None:
        docs, doc, pair, times = aligned(sides, batch)
        self.parts.append((doc + len(self.docs), pair, times))
        self.docs += [{"doc_id": i} | d for i, d in zip(doc_ids, docs)]
        self.bytes += size

    def row(self, chunk: int) -> dict[str, list]:
        doc, pair, times = (np.concatenate(x) for x in zip(*self.parts))
        pairs, at = np.unique(pair, return_inverse=True)
        cuts = np.searchsorted(doc, np.arange(len(self.docs) + 1))
        for d, lo, hi in zip(self.docs, cuts, cuts[1:]):
            d |= {"places": planes(np.diff(at[lo:hi], prepend=0)), "times": planes(times[lo:hi])}
        return {"chunk": [chunk], "pairs": [pairs], "held": [np.bincount(at, minlength=len(pairs))], "docs": [self.docs]}


def chunks(docs: DataFrame, vocabularies: tuple[str, str], batch_bytes: int, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Aligned documents by chunk; and the number of B ids. The vocabulary files are read on the driver and sent once to
    each executor; their size doesn't depend on the data."""
    sources = open(vocabularies[0], encoding="utf-8").read(), open(vocabularies[1], "rb").read()
    sent = docs.sparkSession.sparkContext.broadcast(sources)

    def make() -> Any:
        sides = sides_of(sent.value)
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        chunk = Chunk()
        doc_ids: list[int | None] = []
        held: list[str] = []
        size = 0

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal chunk, size
            for doc_id, text in zip(*batch.columns) if batch is not None else ():
                text = text.as_py()
                doc_ids.append(doc_id.as_py())
                held.append(text)
                size += len(text) + 16
                if size >= batch_bytes:
                    chunk.add(sides, doc_ids, held, size)
                    size = doc_ids.clear() or held.clear() or 0
                    if chunk.bytes >= chunk_bytes:
                        yield chunk.row(next(numbers))
                        chunk = Chunk()
            if batch is None:
                if held:
                    chunk.add(sides, doc_ids, held, size)
                if chunk.docs:
                    yield chunk.row(next(numbers))

        return step

    shape = f"chunk long, pairs array<bigint>, held array<bigint>, docs array<struct<{DOC.replace(' ', ': ').replace(',:', ',')}, places: binary, times: binary>>"
    return scan(texts(docs), make, shape), len(sides_of(sources).b_bytes)


def alignment(docs: DataFrame, vocabularies: tuple[str, str], batch_bytes: int = BATCH_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made, b_size = chunks(docs, vocabularies, batch_bytes, chunk_bytes)
    made = written(made, "alignment-chunks")
    listed = made.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select("chunk", "place", "p.pairs", "p.held")
    counts = written(listed.groupBy("pairs").agg(F.sum("held").alias("count")), "alignment-counts")
    # one row per A id: bounded by the vocabulary
    a_id = F.floor(F.col("pairs") / F.lit(b_size)).alias("a_id")
    best = counts.groupBy(a_id).agg(F.max("count").alias("highest"))
    marked = counts.withColumn("a_id", a_id).join(F.broadcast(best), "a_id").select("pairs", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = listed.drop("held").join(marked, "pairs").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("told"))

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            for own, told in zip(*batch.columns) if batch is not None else ():
                n = len(told.values) if told.is_valid else 0
                count, best = np.zeros(n, np.int64), np.zeros(n, bool)
                if n:
                    place = told.values.field("place").to_numpy()
                    count[place] = told.values.field("count").to_numpy()
                    best[place] = told.values.field("best").to_numpy(zero_copy_only=False)
                out: dict[str, list] = {f: [] for f in (*FACTS, "n_best", "count_sum")}
                for d in own.as_py():
                    at, times = np.cumsum(from_planes(d["places"])), from_planes(d["times"]).astype(np.int64)
                    for f in FACTS:
                        out[f].append(d[f])
                    out["n_best"].append(int(times[best[at]].sum()))
                    out["count_sum"].append(int((times * count[at]).sum()))
                yield out

        return step

    return scan(made.select("chunk", "docs").join(told, "chunk", "left").select("docs", "told"), make, f"{DOC}, n_best bigint, count_sum bigint")


def op12_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), public_vocabularies())
