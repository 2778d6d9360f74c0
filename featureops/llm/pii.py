"""Personal data in texts: exact patterns, and a character-level LSTM with CRF for other spellings.

The patterns give the base spans (email, ip, card, phone). Windows around a bounded sample of them, as
they stand and respelt ("name (at) host dot org", numbers without their plus sign or with other
separators), are the labelled spans on which the tagger is trained; windows without a span, with version
numbers and keys in them, are its counter-examples. Every stretch of every text that holds a digit, an
at sign or a bracketed "at" is decoded as a whole with the text around it, since each of the four kinds holds
one of them; the tags of a long stretch come from overlapping pieces, character by character, and a stretch is
widened while a span meets its edge. So a span is found or not wherever it stands. The spans of a text compete in
one weighted interval selection. A model span joins the result if it overlaps no base span and its digits fit its kind.

Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows each give a
row. With fewer than ``LEAST`` windows to learn from, only the base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import scan, table, texts
from featureops.llm.tagger import Tagger, classes

# The kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]")

SAMPLE = 3_000  # windows to learn from, of each sort
LEAST = 30
WIDTH = 64  # of the windows to learn from
REACH = 128  # characters around a trigger that are decoded with it
PIECE = 1_024  # characters decoded at once
SURE = 0.9  # least posterior probability of every character of a model span
BATCH = 2_048  # pieces of WIDTH characters decoded at once

Span = tuple[int, int, int]  # start, number of the kind, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and without overlap within a kind, in linear time."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        last = max(last, m.end() if m else at + 1)  # what stands before a failed sign can't begin a match
        if m:
            found.append((start, 0, m.end()))
        at = text.find("@", last)
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 12 <= len(number := digits(m.group())) <= 19 and luhn(number):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def respelt(span: str, kind: int, choice: int) -> str:
    """Another spelling of a span of this kind, which the patterns don't find."""
    if kind == 0:
        at = (" (at) ", " [at] ", "[at]", "(at)", " {at} ", " <at> ")[choice % 6]
        dot = (".", " dot ", "[.]", " (dot) ", "(dot)")[choice // 6 % 5]
        local, _, host = span.partition("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", (" . ", "[.]", "(.)", " dot ")[choice % 4])
    if kind == 2:
        d = digits(span)
        return ("." if choice % 2 else "/").join(d[i : i + 4] for i in range(0, len(d), 4))
    bare = span.lstrip("+")
    return (bare, re.sub(r"[ ().-]+", "-", bare), re.sub(r"[ ().-]+", ".", bare), "00" + re.sub(r"[ ().-]+", " ", bare))[choice % 4]


def plausible(text: str, kind: int) -> bool:
    """Do the digits and signs of a model span fit its kind?"""
    number = digits(text)
    if kind == 0:
        return bool(re.search(r"@|[\[({<] ?at ?[\])}>]", text)) and bool(re.search(r"[A-Za-z0-9](\.| dot |\[\.\]| ?\(dot\) ?)[A-Za-z]", text))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(number) <= 19 and luhn(number)
    return 9 <= len(number) <= 15


def sample_windows(docs: DataFrame, bound: int = SAMPLE) -> list[tuple[str, int, int, int]]:
    """(window, kind or -1, start, end) around base spans and around other digits, ``bound`` of either sort,
    those with the least hashes of the whole table."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            out: dict[str, list] = {"piece": [], "kind": [], "start": [], "end": []}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                spans = base_spans(text)
                places = [(s, e, k) for s, k, e in spans]
                starts = [s for s, _, _ in places]
                reach = np.maximum.accumulate([e for _, e, _ in places]) if places else []
                seen = -WIDTH
                for m in TRIGGER.finditer(text):
                    i = bisect_right(starts, m.start())
                    if m.start() - seen >= WIDTH and not (i and reach[i - 1] > m.start()):
                        seen = m.start()
                        places.append((m.start(), m.end(), -1))
                for s, e, k in places:
                    left = max(0, s - (doc or 0) % 24 - 4)
                    piece = text[left : left + WIDTH]
                    inside = [x for x in spans if x[0] < left + WIDTH and x[2] > left]
                    if k < 0 and inside or k >= 0 and (len(inside) > 1 or e - left > WIDTH):
                        continue
                    for c, v in zip(out, (piece, k, s - left, e - left)):
                        out[c].append(v)
            yield out

        return step

    rows = texts(docs).where(F.col("text").rlike(TRIGGER.pattern))
    pieces = scan(rows, make, "piece string, kind int, start int, end int").distinct()
    order = F.xxhash64("piece", "start")
    # the spans may stem from a single kind: an equal share for each
    shares = [(F.col("kind") == k, bound // len(KINDS)) for k in range(len(KINDS))] + [(F.col("kind") < 0, bound)]
    got = [pieces.where(which).orderBy(order, "piece", "start").limit(n) for which, n in shares]
    union = got[0]
    for g in got[1:]:
        union = union.union(g)
    return [tuple(r) for r in union.collect()]


def trained(windows: list[tuple[str, int, int, int]]) -> Tagger | None:
    """Tags: 0 outside, 1 + 2k first character of kind k, 2 + 2k another."""
    if sum(k >= 0 for _, k, _, _ in windows) < LEAST:
        return None
    g = np.random.default_rng(5)
    rows, tags = [], []
    for piece, kind, start, end in sorted(windows):
        variants = [(piece, start, end)]
        if kind >= 0:
            for _ in range(2):
                new = respelt(piece[start:end], kind, int(g.integers(0, 1000)))
                variants.append((piece[:start] + new + piece[end:], start, start + len(new)))
        for text, s, e in variants:
            if len(text) > WIDTH and e > WIDTH:  # keep the span in the window
                cut = min(s, e - WIDTH + int(g.integers(0, 6)))
                text, s, e = text[cut:], s - cut, e - cut
            if kind >= 0 and e > WIDTH:
                continue
            tag = np.zeros(WIDTH, "i8")
            if kind >= 0:
                tag[s:e], tag[s] = 2 + 2 * kind, 1 + 2 * kind
            rows.append(classes(text[:WIDTH].ljust(WIDTH)))
            tags.append(tag)
    return Tagger(1 + 2 * len(KINDS)).fit(np.array(rows), np.array(tags))


def triggered(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end) around triggers, apart from each other."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def selected(spans: list[tuple[int, int, int, float]]) -> list[Span]:
    """Weighted interval selection: spans (start, end, kind, weight) without overlap, of the largest weight."""
    spans = sorted(set(spans), key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (s, _, _, w) in enumerate(spans):
        j = bisect_right(ends, s, 0, i)
        best.append(max((best[i][0], i, False), (best[j][0] + w, j, True)))
    out, i = [], len(spans)
    while i:
        _, j, take = best[i]
        if take:
            s, e, k, _ = spans[i - 1]
            out.append((s, k, e))
        i = j
    return out[::-1]


def decoded(model: Tagger, rows: list[str], places: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tags and their posterior probabilities for each place (row, start, end). A place longer than ``PIECE`` is
    decoded in pieces that overlap by half; each character has its tag from the piece in which it is farther from
    an edge."""
    pieces: list[tuple[int, int, int, int]] = []  # length with padding, place, start, end
    for i, (_, s, e) in enumerate(places):
        for at in range(s, max(s + 1, e - PIECE // 2), PIECE // 2):
            to = min(e, at + PIECE)
            pieces.append((-(-(to - at) // WIDTH) * WIDTH, i, at, to))
    out = [(np.zeros(e - s, "i8"), np.zeros(e - s)) for _, s, e in places]
    pieces.sort()
    at = 0
    while at < len(pieces):
        long = pieces[at][0]
        part = [x for x in pieces[at : at + max(1, BATCH * WIDTH // long)] if x[0] == long]
        at += len(part)
        tags, sure = model.decode(np.array([classes(rows[places[i][0]][a:b].ljust(long)) for _, i, a, b in part]))
        for (_, i, a, b), row, p in zip(part, tags, sure):
            _, s, e = places[i]
            low, high = a + PIECE // 4 * (a > s), b - PIECE // 4 * (b < e)
            out[i][0][low - s : high - s], out[i][1][low - s : high - s] = row[low - a : high - a], p[low - a : high - a]
    return out


def model_spans(model: Tagger, rows: list[str]) -> list[list[Span]]:
    """Spans that the tagger finds in each text. A stretch with a span at its edge is decoded again with more of
    the text around it."""
    places = [(r, s, e) for r, text in enumerate(rows) for s, e in triggered(text)]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in rows]
    while places:
        wider = []
        for (r, s, e), (row, p) in zip(places, decoded(model, rows, places)):
            some, new, cut = np.flatnonzero(row), [], False
            i = int(some[0]) if len(some) else e - s
            while i < e - s:
                if row[i] == 0:
                    i += 1
                    continue
                kind, j = (row[i] - 1) // 2, i + 1
                while j < e - s and row[j] == 2 + 2 * kind:
                    j += 1
                cut |= i == 0 and s > 0 or j == e - s and e < len(rows[r])
                if p[i:j].min() >= SURE:
                    new.append((s + i, s + j, int(kind), float(p[i:j].sum())))
                i = j
            if cut:
                wider.append((r, max(0, s - (e - s)), min(len(rows[r]), e + (e - s))))
            else:
                found[r] += new
        places = wider
    return [selected(x) for x in found]


def found(docs: DataFrame, model: Any, columns: list[str], mask: bool = False) -> DataFrame:
    """``columns`` of docs with n_email .. n_phone, base_sha256 and spans, and with ``mask`` the text without
    its spans as ``masked``; docs has a text column without nulls."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights
    n = len(columns)

    def make() -> Any:
        tagger = held.value

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            rows = batch.column(n).to_pylist()
            base = [base_spans(t) for t in rows]
            more: list[list[Span]] = [[] for _ in rows]
            hot = [i for i, t in enumerate(rows) if TRIGGER.search(t)] if tagger else []
            for i, spans in zip(hot, model_spans(tagger, [rows[i] for i in hot]) if hot else []):
                for s, k, e in spans:
                    if plausible(rows[i][s:e], k) and not any(s < y and x < e for x, _, y in base[i]):
                        more[i].append((s, k, e))
            out: dict[str, Any] = {c: batch.column(j) for j, c in enumerate(columns)}
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(x[1] == k for x in b) for b in base]
            out["base_sha256"] = [hashlib.sha256(told(b).encode()).hexdigest() for b in base]
            out["spans"] = [told(sorted(b + m)) for b, m in zip(base, more)]
            if mask:
                out["masked"] = [masked(t, x) for t, x in zip(rows, out["spans"])]
            yield out

        return step

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", *(["masked string"] if mask else [])])
    return scan(docs.select(*columns, "text"), make, schema)


def detected(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return found(texts(docs), trained(sample_windows(docs, bound)), ["doc_id"])


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, all parts go."""
    out, at = [], 0
    for span in spans.split(",") if spans else ():
        kind, s, e = span.split(":")
        s, e = int(s), int(e)
        if e <= at:
            continue
        out += [text[at : max(at, s)], f"<{kind}>" if s >= at else ""]
        at = e
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, columns: list[str], bound: int = SAMPLE) -> DataFrame:
    """``columns`` of docs and ``masked``, the text in which each span is replaced by its kind."""
    docs = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    return found(docs, trained(sample_windows(docs, bound)), columns, mask=True).select(*columns, "masked")


def op5_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))
