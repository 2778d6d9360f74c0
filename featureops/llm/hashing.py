"""Hashes of words and word sequences, in numpy.

A word is a run between ASCII white space with A-Z lowered. Its hash is a polynomial over its bytes modulo
2**64, mixed afterwards; sequences of words are hashed the same way over the words' hashes. Values depend
on nothing but the bytes, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 20  # bytes hashed at once, up to the next white space

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base = base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up, self.down = np.ones(1, "u8"), np.ones(1, "u8")

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, "u8")
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype="u8"))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums, one longer than x."""
    out = np.zeros(len(x) + 1, "u8")
    np.cumsum(x, out=out[1:])
    return out


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the text's words, and where each begins and ends, in bytes of its UTF-8."""
    raw = np.frombuffer(text.encode().lower(), "u1")
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype("i1")))
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), "u8")
    at = 0
    while at < len(starts):
        # the last word in reach, or one that is longer
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        low, high = starts[at], ends[to - 1]
        up, down = _BYTES.get(int(high - low) + 1)
        total = sums((raw[low:high].astype("u8") + np.uint64(1)) * up[:-1])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mixed(hashes), starts, ends


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, "u8")
    up, down = _WORDS.get(len(words) + 1)
    total = sums(words * up[:-1])
    return mixed((total[size:] - total[:-size]) * down[:n])


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[s:e] for each s, e."""
    up, down = _WORDS.get(len(words) + 1)
    total = sums(words * up[:-1])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("u8"))


def code_points(text: str, at: np.ndarray) -> np.ndarray:
    """Positions in code points for positions in bytes of the UTF-8."""
    raw = np.frombuffer(text.encode(), "u1")
    if len(raw) == len(text):
        return at
    count = np.zeros(len(raw) + 1, "i8")
    np.cumsum((raw & 0xC0) != 0x80, out=count[1:])
    return count[at]
