"""Methods against brute force, exact round trips and held-out labels."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import connect, differences
from featureops.llm import bpe, grammar, ngram_join, pii, repeats, rule_ensemble, tagger, wrappers
from featureops.llm.decontaminate import common_length
from featureops.llm.hashing import code_points, sequence_hashes, word_hashes
from featureops.llm.queries import QUERIES
from featureops.llm.sql import SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


def test_encoding_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.public_vocabulary()
    ours, theirs = bpe.Coder(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    g = random.Random(1)
    signs = "ab cdeé ñ’'stß\n\t 12٣🙂#|<|endoftext|> \x1c\x85 the"
    texts = ["".join(g.choices(signs, k=g.randrange(80))) for _ in range(600)] + ["a" * 4000, "ab" * 900, " " * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids, repr(text)
        assert ours.decode(ours.encode(text)).decode() == theirs.decode(ids, skip_special_tokens=False) == text


def test_base_spans_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    g = random.Random(2)
    for _ in range(4000):
        text = "".join(g.choices("a1.@-+ %é(", k=g.randrange(40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        assert [s for s in pii.base_spans(text) if s[1] == 0] == want, repr(text)
        ips = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
        assert [s for s in pii.base_spans(text) if s[1] == 1] == [(m.start(), 1, m.end()) for m in ips if all(int(p) <= 255 for p in m.group().split("."))]
    assert pii.told(pii.base_spans("call +1 (988) 555-2485 or 4041894974608795")) == "phone:5:22,card:26:42"


def test_tagger_learns_spans_and_gradients():
    g = np.random.default_rng(0)
    t = tagger.Tagger(3, 4, 5)
    t.p = {k: v.astype("f8") for k, v in t.p.items()}
    x, y = g.integers(0, tagger.CLASSES, (3, 7)), g.integers(0, 3, (3, 7))
    _, grads = t.gradients(x, y)
    for name in ("T", "Uf", "Wb", "O", "S"):
        at = tuple(g.integers(0, s) for s in t.p[name].shape)
        old, out = t.p[name][at], []
        for d in (1e-3, -1e-3):
            t.p[name][at] = old + d
            out.append(t.gradients(x, y)[0])
        t.p[name][at] = old
        assert grads[name][at] == pytest.approx((out[0] - out[1]) / 2e-3, rel=0.05, abs=2e-4)


def test_spelled_out_addresses_are_found():
    g = random.Random(3)
    word = lambda: "".join(g.choices("aeiourstnl", k=g.randrange(2, 8)))
    windows = []
    for i in range(400):
        span = [f"{word()}.{i % 90}@{word()}.example.com", f"{i % 250}.{i % 201}.7.{i % 99}", f"+1 ({200 + i}) 555-{1000 + i}"][i % 3]
        before, after = " ".join(word() for _ in range(2)) + " ", " " + " ".join(word() for _ in range(5))
        windows.append(((before + span + after)[:64], [0, 1, 3][i % 3], len(before), len(before) + len(span)))
        windows.append(((" ".join(word() for _ in range(4)) + f" version {i % 9}.0 " + word() * 5)[:64], -1, 0, 0))
    model = pii.trained([w for w in windows if w[3] <= 64])
    hits = 0
    for i in range(30):
        text = f"{word()} {word()} {word()}.{i} (at) {word()} dot example dot com {word()} {word()}"
        spans = pii.model_spans(model, [text])[0]
        hits += any(k == 0 and "(at)" in text[s:e] for s, k, e in spans)
    assert hits >= 20
    assert pii.selected([(0, 5, 0, 4.0), (3, 9, 0, 5.0), (9, 12, 1, 1.0)]) == [(3, 0, 9), (9, 1, 12)]


def test_hashes_follow_words():
    text = "The QUICK  é\tfox\nthe quick"
    words, starts, ends = word_hashes(text)
    assert len(words) == 6 and words[0] == words[4] and words[1] == words[5] and len(set(words.tolist())) == 4
    s, e = code_points(text, starts), code_points(text, ends)
    assert [text[a:b] for a, b in zip(s, e)] == text.split()
    runs = sequence_hashes(words, 2)
    assert runs[0] == runs[4] and len(set(runs.tolist())) == 4


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if False else _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        return new

    g = np.random.default_rng(1)
    for _ in range(200):
        a, b = g.integers(0, 6, g.integers(1, 70)), g.integers(0, 6, g.integers(0, 90))
        assert common_length(a, b) == slow(a.tolist(), b.tolist())


def test_posterior_keeps_true_pairs():
    for n, m in ngram_join.least_matches(0.8, ngram_join.TOLERANCE, 16, 80):
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost < 1e-4


def test_join_in_many_cells(spark, monkeypatch):
    """A group of near copies larger than a block, copies, and a common line, against all pairs."""
    g = random.Random(5)
    base = [f"b{g.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(330):
        words = list(base)
        for _ in range(g.randrange(4)):
            words[g.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, "one very common line of text " + " ".join(f"r{i}x{k}" for k in range(g.randrange(3, 40)))) for i in range(100)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t in rows}
    links, up = Counter(), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert got == {i: (top(i), links[i]) for i in sets}


@pytest.mark.parametrize("hot", [repeats.HOT, 5])
def test_repeats_on_random_texts(spark, hot):
    g = random.Random(9)
    passages = [[f"p{k}w{i}" + "x" * (300 * (i % 17 == 0)) for i in range(g.randrange(40, 130))] for k in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(3):
            words += [f"u{g.randrange(10**6)}" for _ in range(g.randrange(0, 60))]
            p = passages[g.randrange(6)]
            a = g.randrange(0, 20)
            words += p[a : len(p) - g.randrange(0, 20)]
        rows.append((d, " ".join(words)))
    windows = defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    want = Counter()
    for d, t in rows:
        w, covered = t.split(), set()
        for i in range(len(w) - 49):
            if len(windows[tuple(w[i : i + 50])]) > 1:
                covered.update(range(i, i + 50))
        want[d] = len(covered)
    got = Counter()
    for r in repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string"), hot).collect():
        got[r.doc_id] += r.n_words
        assert len(rows[r.doc_id][1][r.start : r.end].split()) == r.n_words
    assert got == +want


def test_grammar_marks():
    m, insult = grammar.Machine(), (grammar.INSULT, 1.0)
    other, target, no, said = (grammar.OTHER, 0.0), (grammar.TARGET, 0.0), (grammar.NEGATION, 0.0), (grammar.REPORT, 0.0)
    name = lambda clause: [f for f, v in zip(grammar.FEATURES, m.run(clause)) if v]
    assert name([other, insult]) == ["insult"] and name([target, other, insult]) == ["insult_targeted"]
    assert name([no, other, insult]) == ["insult_negated"] and name([no] + [other] * 5 + [insult]) == ["insult"]
    assert name([said, insult]) == ["insult_reported"] and name([said, no, insult]) == ["insult_negated_reported"]


def test_rules_separate():
    g = np.random.default_rng(4)
    x = g.random((800, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype("f8")
    model = rule_ensemble.fit(x[:500], y[:500])
    assert (((model.raw(x[500:]) > 0) == y[500:]).mean()) > 0.97 and len(model.rules) < 120


@pytest.mark.parametrize("name, label", [("op3_toxicity_grammar", "toxic"), ("op4_quality_rule_ensemble", "quality")])
def test_held_out_labels(spark, name, label):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() > 0.9
    mod, held = (5, 0) if label == "toxic" else (3, 1)
    assert all(zlib.crc32(str(d).encode()) % mod == held for d in got["doc_id"])


def test_wrapper_finds_the_article_without_names():
    page = ('<html><body><div id="top">Menu <a href=x>a</a></div><div class="wrap"><h2>H%d</h2><p>Text number %d is long enough to count.</p>'
            '<p>Second %d</p></div><div class="bottom">Same always</div></body></html>')
    pages = [page % (i, i, i) for i in range(5)]
    wrapper = wrappers.json.loads(wrappers.inferred(pages))
    assert wrappers.main_text(pages[3], wrapper) == "H3\n\nText number 3 is long enough to count.\n\nSecond 3"
    rich = ('<body><header><h1>Site</h1></header><div class="cookie-notice">no</div><main><article><header><h1>T &eacute;&nbsp;x</h1></header><p>One<p>Two<br>three'
            '<div class="ad-box">buy</div><ul><li>a<li>b</ul><form><input>m</form><section class="comments"><article><p>no</p></article></section></article></main><aside>s</aside>')
    assert wrappers.main_text(rich, None) == "T é x\n\nOne\n\nTwo three\n\na\n\nb"
