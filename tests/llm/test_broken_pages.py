"""Broken and wide pages: the reading of markup against its plain definition, and its time."""

from __future__ import annotations

import random
import re
import time

from featureops.llm import wrappers
from featureops.llm.page_tree import RAW, blocks, tokens, tree_of

# The definition; a regular expression that takes quadratic time on broken tags.
PLAIN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<", re.S | re.I)
BITS = ["<", ">", "'", '"', "</", "<!", "<!--", "-->", "<?", "a", "p class=", "script", "</script >", "STYLE", "svg-x", " ", "=", "text", "/>", "\n", "<div>", "</div>", "é"]


def test_tokens_follow_the_definition():
    g = random.Random(7)
    for _ in range(20_000):
        page = "".join(g.choices(BITS, k=g.randrange(30)))
        want = [m.group() for m in PLAIN.finditer(page) if not m.group(1) and not m.group().startswith(("<!", "<?"))]
        assert list(tokens(page)) == want, page


def test_broken_pages_take_linear_time():
    for unit in ("<a ", "<a '", '<a "', "<!", "<script ", "<b><ul>", "<div></x>", "<p", "</b", "<!-", "<a x='\"' "):
        page = unit * (1_000_000 // len(unit))
        began = time.monotonic()
        for _ in blocks(tree_of(page)):
            pass
        assert time.monotonic() - began < 10, unit


def parts(keys):
    return [{"key": k} for k in keys]


def test_pairing_is_a_longest_common_subsequence(monkeypatch):
    g = random.Random(3)
    for _ in range(300):
        x, y = ([g.choice("abcd") for _ in range(g.randrange(14))] for _ in range(2))
        lengths = []
        for cells in (250_000, 4):
            monkeypatch.setattr(wrappers, "CELLS", cells)
            got = wrappers.pairing(parts(x), parts(y))
            assert [a["key"] for a, _ in got if a] == x and [b["key"] for _, b in got if b] == y
            assert all(a["key"] == b["key"] for a, b in got if a and b)
            lengths.append(sum(1 for a, b in got if a and b))
        assert lengths[0] == lengths[1]


def test_wide_pages_align_in_bounded_memory():
    x = [f"k{i}" for i in range(6_000)]
    began = time.monotonic()
    got = wrappers.pairing(parts(x), parts([f"z{i}" if i % 3 else f"k{i}" for i in range(6_000)]))
    assert sum(1 for a, b in got if a and b) == 2_000 and time.monotonic() - began < 30


def test_a_large_host_is_dealt_in_pieces(spark, monkeypatch):
    page = lambda i: f"<html><body><nav>menu</nav><article><p>story {i}</p></article></body></html>"
    rows = [(i, f"http://{'big' if i % 2 else f'h{i}'}.org/{i}", page(i)) for i in range(60)] + [(None, None, None), (7, "http://big.org/7", "<p>again</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = pages.withColumn("host", wrappers.host())
    monkeypatch.setattr(wrappers, "PIECES", 10)
    assert {tuple(r) for r in wrappers.pieces(hosts).collect()} == {("big.org", 5)}
    some = sorted(wrappers.extracted(pages).collect(), key=str)
    monkeypatch.setattr(wrappers, "PIECES", 1)  # no host has over all pages: none is split
    assert wrappers.pieces(hosts).isEmpty()
    assert sorted(wrappers.extracted(pages).collect(), key=str) == some and len(some) == len(rows)
    assert wrappers.extracted(pages.limit(0)).isEmpty()
