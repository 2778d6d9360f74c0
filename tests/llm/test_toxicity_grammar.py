"""Patterns of the toxicity grammar: their order, and that they change decisions."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest

from featureops.llm import toxicity
from featureops.llm.grammar import FEATURES, INSULT, OTHER, TARGET, THREAT, Machine

INSULTS = ("blorky", "snarfled", "wugging")
FILLER = "the river ran past green fields while old stones kept their moss and birds sang over hills".split()


@pytest.fixture(scope="module")
def lexicon(spark):
    """Plain insults only: what the labels don't show keeps the grammar's own order."""
    g = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(400):
        row = list(g.choice(FILLER, 12))
        toxic = i % 4 == 0
        if toxic:
            row[5] = INSULTS[i // 4 % 3]
        docs.append((i, " ".join(row)))
        labels.append((i, int(toxic)))
    return toxicity.fitted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def score(lexicon, text):
    return lexicon.score(lexicon.features(text))


def test_order_of_patterns(lexicon):
    plain, aimed = score(lexicon, "what a blorky day."), score(lexicon, "you are a blorky.")
    negated, reported = score(lexicon, "that was not a blorky day."), score(lexicon, "the paper wrote of a blorky day.")
    both = score(lexicon, "the paper wrote that was not blorky.")
    threat, nobody = score(lexicon, "i will kill you."), score(lexicon, "frosts kill roses.")
    clean = score(lexicon, "the river ran past green fields.")
    assert threat >= aimed > plain > max(negated, reported) and min(negated, reported) > both > clean
    assert plain >= 0.5 and max(negated, reported) < plain and threat > nobody > clean


def test_patterns_change_decisions(lexicon):
    word_list = dataclasses.replace(lexicon, strengths=(1.0,) * len(FEATURES))
    sentences = [f"{head} {w}." for w in INSULTS for head in ("you are a", "that was not", "they said it was never", "oh")]
    with_grammar = [score(lexicon, t) >= 0.5 for t in sentences]
    assert with_grammar != [score(word_list, t) >= 0.5 for t in sentences]


def test_strengths_follow_labels_and_keep_their_order():
    x = np.zeros((60, len(FEATURES)))
    k = FEATURES.index
    x[:20, k("insult")], x[20:40, k("insult_negated")], x[40:60, k("threat_targeted")] = 3.0, 3.0, 3.0
    y = np.r_[np.ones(40), np.zeros(20)]
    got = dict(zip(FEATURES, toxicity.strengths_of(x, y, 1.0)))
    assert 0.25 < got["insult_negated"] <= got["insult"] == 1.0 <= got["insult_targeted"]
    assert got["threat_targeted"] < 0.5  # clean texts hold it
    none = dict(zip(FEATURES, toxicity.strengths_of(np.zeros((0, len(FEATURES))), np.zeros(0), 1.0)))
    assert all(math.isclose(none[f"insult{m}"], s) for m, s in toxicity.STRENGTHS.items())


def test_a_threat_waits_for_its_target():
    run = lambda *kinds: dict(zip(FEATURES, Machine().run([(c, float(c in (THREAT, INSULT))) for c in kinds])))
    assert run(OTHER, THREAT, TARGET) == dict.fromkeys(FEATURES, 0.0) | {"threat_targeted": 1.0}
    assert run(THREAT, OTHER, OTHER, OTHER, OTHER, TARGET)["threat"] == 1.0
    assert run(THREAT, THREAT, TARGET) == dict.fromkeys(FEATURES, 0.0) | {"threat": 1.0, "threat_targeted": 1.0}
    assert run(INSULT, TARGET)["insult"] == 1.0
