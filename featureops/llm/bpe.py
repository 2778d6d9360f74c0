"""Byte-level BPE encoding and decoding by forced boundaries.

A merge never spans two neighbouring bytes that stand side by side in no vocabulary token, so such a
pair is a certain cut. Each piece of the text (as the vocabulary's splitting pattern gives it) is cut
there; the fragments are encoded independently and their ids are concatenated. Repeated pieces come
from a bounded memo.

Null and empty texts have no ids. Special tokens in a text are recognised as the vocabulary file says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from featureops.llm.common import scan, table, texts

# The splitting pattern of this kind of vocabulary, with white space as Unicode lists it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
MEMO = 800_000  # pieces remembered by a worker
SHORT = 24  # bytes; shorter fragments are merged without a queue
LONG_PIECE = 256  # longer ones are encoded anew each time


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, source: str) -> None:
        import regex

        spec = json.loads(source)
        signs = byte_signs()
        as_bytes = lambda token: bytes(signs[c] for c in token)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            if token not in special:
                self.tokens[i] = as_bytes(token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.single = [0] * 256
        self.inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            if token in special:
                continue
            b = self.tokens[i]
            if len(b) == 1:
                self.single[b[0]] = i
            for pair in zip(b, b[1:]):
                self.inside[pair] = True
        self.allowed = {(a << 8) | b for a, b in zip(*np.nonzero(self.inside))}
        self.merges: dict[int, tuple[int, int]] = {}  # left id * 2^32 + right id -> rank, new id
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.pieces = regex.compile(PATTERN).findall
        self.special = special
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        start, allowed = 0, self.allowed
        for i in range(1, len(piece)):
            if (piece[i - 1] << 8) | piece[i] not in allowed:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def merged(self, fragment: bytes) -> list[int]:
        """Merges in order of rank, leftmost first; long fragments from a queue over a linked list: n log n."""
        ids = [self.single[b] for b in fragment]
        n, merges = len(ids), self.merges
        if n < SHORT:
            found = [merges.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
            while any(found):
                _, new, i = min((m[0], m[1], i) for i, m in enumerate(found) if m)
                ids[i : i + 2] = [new]
                del found[i]
                if i < len(found):
                    found[i] = merges.get(new << 32 | ids[i + 1])
                if i:
                    found[i - 1] = merges.get(ids[i - 1] << 32 | new)
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get(new << 32 | ids[k]):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges.get(ids[h] << 32 | new)):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        ids: list[int] = []
        for fragment in self.fragments(raw):
            ids += self.merged(fragment)
        return np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        memo, out = self.memo, []
        for p in self.pieces(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= LONG_PIECE:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The text of these ids, in UTF-8; broken sequences become the replacement sign."""
        raw = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_CODERS: dict[int, Coder] = {}


def coder_of(source: str) -> Coder:
    """One coder, with its memo, for all tasks of a worker."""
    key = hash(source)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(source)
    return _CODERS[key]


def coded(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves.

    One pass without a shuffle. The vocabulary file is read on the driver and sent once to each executor;
    its size doesn't depend on the data."""
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def make() -> Any:
        coder = coder_of(source.value)

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            out: dict[str, list] = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept: list = []
            for value in batch.column(1):
                ids = coder.encode(value.as_py())
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype("int32"))
            yield out | ({"ids": kept} if with_ids else {})

        return step

    return scan(texts(docs), make, schema)


def op7_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), public_vocabulary())
