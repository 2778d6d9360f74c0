"""Toxicity by a weighted finite-state pattern grammar.

The insult lexicon is learned: words, and stems of four to eight letters (for words that go on after them),
that mark toxic texts among at most ``FIT_ROWS`` labelled training rows of each class (least hash of the
doc_id, each text once). A term counts if its log likelihood ratio against chance exceeds the logarithm of
the number of terms by ``MARGIN``. A word's arc weight is the log odds of its share of toxic texts (at even
classes), which backs off from the word to its stems, from longer to shorter ones. Threats, targets,
negations and reporting words are fixed lists; a threat weighs as much as the strongest insult. The composed
transducers of ``grammar`` read each clause that holds a term.

A matched clause counts its arc weights times its pattern's strength. Strengths start from ``STRENGTHS`` (a plain
insult is 1) and follow the labelled texts in which the pattern stands alone, with ``STRENGTH_PRIOR`` texts for the
start; they keep their order: targeted at least plain, plain at least negated and reported, those at least both. So
an aimed insult never counts less than a plain one, and few labels leave the grammar's own order. A text's score is
a logistic function of the logarithm of the sum, fitted on the same rows and corrected for the classes' shares.

Every text is read whole, in one pass without a shuffle. Null and empty texts get the score of a text
without a match. Repeated rows each get a row. Without labels of both classes the lexicon is empty and the
score is the share of toxic training rows (one half without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import remainder, scan, table, texts, written
from featureops.llm.grammar import CLAUSE_ENDS, FEATURES, INSULT, KINDS, NEGATION, NEGATIONS, OTHER, QUOTE, QUOTES, REPORT, REPORTS, TARGET, TARGETS, THREAT, THREATS, Machine
from featureops.llm.quality import training_rows
from featureops.llm.rule_ensemble import lasso_logistic

FIT_ROWS = 10_000
HOLD_MOD, HELD = 5, 0
STEMS = range(4, 9)
MARGIN = 3.0
PURITY = 0.75  # least share of toxic texts, at even classes, for a word to be an insult
PRIOR = 2.0  # texts that a shorter stem's share counts as
STRENGTHS = {"": 1.0, "_targeted": 1.25, "_negated": 0.25, "_reported": 0.4, "_negated_reported": 0.1}
UNAIMED = 0.1  # start of a threat at nobody, as a share of an aimed one
STRENGTH_PRIOR = 8.0  # texts that a start counts as
SEEN = 2  # least number of texts with a term that refines a stem
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[" + re.escape(QUOTES + CLAUSE_ENDS) + "]")


@dataclass
class Lexicon:
    """Numbers of toxic and clean texts (at even classes) by term, the patterns' strengths, the logistic function.

    ``starts`` are the shortest terms that count; a word is looked up if it begins with one."""

    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    starts: frozenset[str] = frozenset()
    bias: float = 0.0
    slope: float = 0.0
    threat: float = 1.0
    strengths: tuple[float, ...] = (0.0,) * len(FEATURES)

    def __post_init__(self) -> None:
        self.machine = Machine()
        self.known: dict[str, tuple[int, float]] = {}
        self.search: Any = None

    def insult(self, word: str) -> float:
        """Arc weight of a word as an insult, or 0."""
        share, counts = 0.5, False
        for term in [*(word[:n] + "*" for n in STEMS if len(word) > n), word]:
            counts |= term in self.starts
            if counts and (seen := self.terms.get(term)):
                share = (seen[0] + PRIOR * share) / (seen[0] + seen[1] + PRIOR)
        return math.log(share / (1 - share)) if share >= PURITY else 0.0

    def token(self, word: str) -> tuple[int, float]:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            weight = self.insult(word)
            kind = INSULT if weight else THREAT if word in THREATS else NEGATION if word in NEGATIONS else TARGET if word in TARGETS else REPORT if word in REPORTS else QUOTE if word in QUOTES else OTHER
            self.known[word] = (kind, weight if weight else self.threat * (kind == THREAT))
        return self.known[word]

    def found(self, text: str) -> bool:
        """Does the text hold a term or threat anywhere? One pass of a keyword automaton."""
        if self.search is None:
            import ahocorasick

            self.search = ahocorasick.Automaton()
            for term in {t.rstrip("*") for t in self.starts} | THREATS:
                self.search.add_word(term, True)
            self.search.make_automaton()
        return next(self.search.iter(text), None) is not None

    def features(self, text: str) -> list[float]:
        """Sums of arc weights by pattern over all matched clauses."""
        total = [0.0] * len(FEATURES)
        low = text.lower()
        if not self.found(low):
            return total
        clause: list[tuple[int, float]] = []
        hit = False
        for token in [*TOKEN.findall(low), "\n"]:
            if token in CLAUSE_ENDS:
                if hit:
                    total = [a + b for a, b in zip(total, self.machine.run(clause))]
                clause, hit = [], False
            else:
                clause.append(self.token(token))
                hit |= clause[-1][0] <= THREAT
        return total

    def score(self, features: list[float]) -> float:
        raw = self.bias + self.slope * math.log1p(sum(s * x for s, x in zip(self.strengths, features)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, raw))))


def terms(text: str) -> set[str]:
    """Words of a text, and with a star the stems of words that go on."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 1}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: numbers of texts with it."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[int(y)].update(terms(text.as_py()))
            keys = list({*counts[0], *counts[1]})
            yield {"term": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}

        return step

    parts = scan(rows.select("text", "y"), make, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def with_stems(words: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """The words' numbers, and their stems' with one vote from each word that goes on: a stem that owes its
    texts to a single word says nothing about others."""
    votes: dict[str, list[float]] = {}
    for word, (a, b) in words.items():
        share = (a + 0.5) / (a + b + 1)
        for n in STEMS:
            if len(word) > n:
                vote = votes.setdefault(word[:n] + "*", [0.0, 0.0])
                vote[0] += share
                vote[1] += 1 - share
    return words | {t: (a, b) for t, (a, b) in votes.items()}


def starts_of(kind: str) -> dict[str, float]:
    """Where the patterns of a kind start; a threat is one if it is aimed."""
    aimed = STRENGTHS["_targeted"]
    return STRENGTHS if kind == "insult" else {m: aimed if m == "_targeted" else UNAIMED * aimed * STRENGTHS[m] for m in STRENGTHS}


def strengths_of(x: np.ndarray, y: np.ndarray, even: float) -> tuple[float, ...]:
    """Strength of each pattern from the texts' weights by pattern; a clean text counts ``even`` times."""
    hit = x > 0
    alone = hit.sum(1) == 1
    odds = lambda share: math.log(share / (1 - share))
    seen = [(float((hit[:, k] & alone & (y > 0)).sum()), even * float((hit[:, k] & alone & (y == 0)).sum())) for k in range(len(FEATURES))]
    toxic, clean = seen[FEATURES.index("insult")]
    plain = max(odds(PURITY), odds((toxic + PRIOR * PURITY) / (toxic + clean + PRIOR)))
    out: dict[str, float] = {}
    for kind in KINDS:
        for mark, start in starts_of(kind).items():
            a, b = seen[FEATURES.index(kind + mark)]
            share = (a + STRENGTH_PRIOR / (1 + math.exp(-start * plain))) / (a + b + STRENGTH_PRIOR)
            out[kind + mark] = max(0.0, odds(share) / plain)
        if kind == "insult":
            out[kind] = 1.0
        out[kind + "_targeted"] = max(out[kind], out[kind + "_targeted"])
        for mark in ("_negated", "_reported"):
            out[kind + mark] = min(out[kind], out[kind + mark])
        out[kind + "_negated_reported"] = min(out[kind + m] for m in ("_negated", "_reported", "_negated_reported"))
    return tuple(out[f] for f in FEATURES)


def fitted(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Lexicon:
    rows = training_rows(labels, "toxic", HOLD_MOD, HELD)
    shares = {int(y): n for y, n in rows.groupBy("y").count().collect() if y in (0.0, 1.0)}
    if len(shares) < 2:
        p = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
        return Lexicon(bias=math.log(p / (1 - p)))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [rows.where(F.col("y") == y).orderBy(*order).limit(bound) for y in (0.0, 1.0)]
    named = texts(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most twice ``bound`` rows
    named = written(named.select("text", "y").distinct(), "toxicity-fit")
    sizes = {int(y): n for y, n in named.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon(bias=math.log(shares[1] / shares[0]))

    counts = written(term_counts(named), "toxicity-terms")
    p, n = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * q))).otherwise(0.0)
    limit = math.log(max(1, counts.count())) + MARGIN
    marked = [r[0] for r in counts.where((F.col("toxic") > n * p) & (part("toxic", p) + part("clean", 1 - p) >= limit)).select("term").collect()]
    stems = {t[:-1] for t in marked if t.endswith("*")}
    starts = frozenset(t for t in marked if not any(t.rstrip("*")[:k] in stems and t != t[:k] + "*" for k in STEMS if k < len(t.rstrip("*")) or not t.endswith("*")))
    heads = sorted({t.rstrip("*")[: min(STEMS)] for t in starts})
    near = counts.where(F.left("term", F.lit(min(STEMS))).isin(heads) & (n >= SEEN)) if heads else counts.limit(0)
    even = toxic / clean
    kept = with_stems({t: (float(a), b * even) for t, a, b in near.where(~F.col("term").endswith("*")).collect()})
    arcs = Lexicon(kept, starts)
    insults = [w for t in kept if not t.endswith("*") and (w := arcs.insult(t))]
    threat = max(insults, default=1.0)
    lexicon = Lexicon(kept, starts, threat=threat)
    got = featured(named, lexicon).toPandas()
    x = np.array(got["features"].tolist(), "f8").reshape(-1, len(FEATURES))
    y = got["y"].to_numpy("f8")
    strengths = strengths_of(x, y, even)
    weight = np.where(y > 0, shares[1] / toxic, shares[0] / clean)
    bias, w = lasso_logistic(np.log1p(x @ np.array(strengths))[:, None], y, weight, 1e-4, 500)
    return Lexicon(kept, starts, bias, max(0.0, float(w[0])), threat, strengths)


def featured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """y and features of the fitted rows."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is not None:
                yield {"y": batch.column(1), "features": [lexicon.features(t.as_py()) for t in batch.column(0)]}

        return step

    return scan(rows.select("text", "y"), make, "y double, features array<double>")


def scored(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    lexicon = fitted(docs, labels, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(HOLD_MOD) == HELD).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is not None:
                scores = [lexicon.score(lexicon.features(t.as_py())) for t in batch.column(2)]
                yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return step

    return scan(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
