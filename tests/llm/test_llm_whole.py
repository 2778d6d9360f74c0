"""Whole jobs: cases that bounds, prefixes, neighbours or edges once cut off."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from featureops.llm import decontaminate, lm, pii, repeats, tagger, wrappers


def test_scores_equal_a_plain_backoff_model(spark):
    """More tokens than 2**17, so that a share of them once left out words and n-grams that occur twice."""
    g = random.Random(12)
    rows = [(i, " ".join(f"w{int(g.paretovariate(0.7)) % 40_000}" for _ in range(g.randrange(400, 700)))) for i in range(330)]
    rows += [(1000 + i, "rare pair of words " * 2 + f"once{i}") for i in range(4)] + [(2000, None), (2001, ""), (2001, "")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = {r.doc_id: r.held_out for r in got}
    seq = lambda t: ["\n", *(t or "").split(), "\n"]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            s = seq(t)
            c1.update(s[1:])
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    total = sum(c1.values())
    assert total > 1 << 17
    p1 = lambda w: (c1[w] + 0.1) / (total + 0.1 * (len(c1) + 1))
    arcs = {2: defaultdict(dict), 3: defaultdict(dict)}
    for (v, w), n in c2.items():
        if n >= 2:
            arcs[2][v][w] = (n - 0.75) / c1[v]
    for (u, v, w), n in c3.items():
        if n >= 2:
            arcs[3][u, v][w] = (n - 0.75) / c2[u, v]
    left = lambda own, low: max(1e-12, 1 - sum(own.values())) / max(1e-12, 1 - sum(low(w) for w in own))
    back_1 = {v: left(own, p1) for v, own in arcs[2].items()}
    p2 = lambda v, w: arcs[2][v][w] if w in arcs[2].get(v, ()) else back_1.get(v, 1) * p1(w)
    back_2 = {h: left(own, lambda w: p2(h[1], w)) for h, own in arcs[3].items()}

    def p3(u, v, w):
        own = arcs[3].get((u, v), ())
        return own[w] if w in own else back_2.get((u, v), 1) * p2(v, w)

    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert len(got) == len(rows)
    for r in got:
        s = seq(next(iter(texts[r.doc_id])))
        want = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        assert r.score == pytest.approx(want, abs=1e-6) and r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in s[1:]), abs=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s) - 1, sum(w in c1 for w in s[1:]), total)


class Marks:
    """Tags runs of # and @ as a span of kind 0."""

    def decode(self, x):
        on = np.isin(x, tagger.classes("#@"))
        first = on & ~np.pad(on, ((0, 0), (1, 0)))[:, :-1]
        return np.where(on, 2 - first, 0), np.ones(x.shape)


@pytest.mark.parametrize("size", [30, 46, 63, 64, 90, 120, 400, 3000])
def test_spans_are_found_at_every_offset(size):
    for offset in range(32):
        for sign in (0, size // 2, size - 1):
            span = "#" * sign + "@" + "#" * (size - sign - 1)
            texts = ["x" * (640 + offset) + span + "y" * 700, "z" * offset + span, span + " end"]
            assert pii.model_spans(Marks(), texts) == [[(640 + offset, 0, 640 + offset + size)], [(offset, 0, offset + size)], [(0, 0, size)]]


def test_long_respelt_addresses_are_found_at_every_offset():
    g = random.Random(3)
    word = lambda: "".join(g.choices("aeiourstnl", k=g.randrange(2, 8)))
    windows = []
    for i in range(600):
        span = [f"{word()}.{word()}@{word()}.{word()}.org", f"{i % 250}.{i % 201}.7.{i % 99}", f"+1 ({200 + i}) 555-{1000 + i}"][i % 3]
        before, after = " ".join(word() for _ in range(2)) + " ", " " + " ".join(word() for _ in range(5))
        windows.append(((before + span + after)[:64], [0, 1, 3][i % 3], len(before), len(before) + len(span)))
        windows.append(((" ".join(word() for _ in range(4)) + f" version {i % 9}.0 " + word() * 5)[:64], -1, 0, 0))
    model = pii.trained([w for w in windows if w[3] <= 64])
    span = "first.last (at) department dot company dot org"
    # the same words around it, so that offsets differ in nothing else
    texts = [("stain rust tone lure " * 20)[offset:] + span + " tone sail" + " lure" * 60 for offset in range(32)]
    found = [[t[s:e] for s, k, e in spans if k == 0] for t, spans in zip(texts, pii.model_spans(model, texts))]
    assert all(span in x for x in found), found


def test_repeats_around_a_very_frequent_line(spark):
    """The nearest neighbours of a frequent line share less than 50 words, other occurrences more."""
    g = random.Random(4)
    line = [f"line{i}" for i in range(40)]
    opening, closing = ([[f"{kind}{k}x{i}" for i in range(5)] for k in range(10)] for kind in "oc")
    rows = []
    for d in range(400):
        own = lambda n: [f"u{g.randrange(10**7)}" for _ in range(n)]
        rows.append((d, " ".join(own(g.randrange(20, 60)) + g.choice(opening) + line + g.choice(closing) + own(g.randrange(20, 60)))))
    # a document with the same surroundings as others, and the same window elsewhere among other words
    shared = [f"s{i}" for i in range(200)]
    rows += [(500, " ".join(shared + ["gap"] * 3 + ["q", *shared[60:111], "r"])), (501, " ".join(shared))]
    windows = defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    want = Counter()
    for d, t in rows:
        w = t.split()
        want[d] = len({x for i in range(len(w) - 49) if len(windows[tuple(w[i : i + 50])]) > 1 for x in range(i, i + 50)})
    got = Counter()
    for r in repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] += r.n_words
    assert got == +want


def test_repeated_groups_are_compared_whole():
    menu, named, plain = "Menu entry " * 60, "<div class=row>%s</div><div class=row><article><p>%s</article></div><div class=row>Footer</div>", "<div>%s</div><div><p>%s</p></div><div>Footer</div>"
    for shape in (named, plain):
        pages = [f"<html><body>{shape % (menu, f'Text {i} is the only one of its kind on this host, number {i * 7}.')}</body></html>" for i in range(5)]
        wrapper = wrappers.json.loads(wrappers.inferred(pages))
        for i, page in enumerate(pages):
            assert wrappers.main_text(page, wrapper) == f"Text {i} is the only one of its kind on this host, number {i * 7}."
    # pages that agree in their first 400 characters
    pages = [f"<html><body><div><div>{menu}{i}</div></div></body></html>" for i in range(5)]
    assert all(wrappers.main_text(p, wrappers.json.loads(wrappers.inferred(pages))) for p in pages)


def test_leaks_equal_common_subsequences(spark):
    """Short items with a quarter of their words replaced, among other words of the benchmark."""
    g = random.Random(8)
    pool = [f"v{i}" for i in range(900)]
    items = [(i, [g.choice(pool) for _ in range(g.randrange(15, 21))]) for i in range(80)]
    rows = []
    for d in range(240):
        words = list(items[d % 80][1])
        for at in g.sample(range(len(words)), len(words) // 4):
            words[at] = g.choice(pool)
        rows.append((d, " ".join([g.choice(pool) for _ in range(g.randrange(40, 90))] + words + [g.choice(pool) for _ in range(g.randrange(40, 90))])))
    number = {w: i for i, w in enumerate(pool)}
    want = set()
    for d, t in rows:
        w = np.array([number[x] for x in t.split()])
        for i, item in items:
            known = np.array([number[x] for x in item])
            if any(decontaminate.common_length(known, w[at : at + len(known)]) >= decontaminate.SURE * len(known) for at in range(len(w) - len(known) + 1)):
                want.add((d, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert len(want) >= 230 and want <= got, sorted(want - got)
