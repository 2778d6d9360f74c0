"""The prefix trie against brute force over plain turn sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from featureops.llm import prefix_trie
from featureops.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ["node", "conv", "place", "depth", "n", "least", "salt", "parent", "words"]


def brute(rows):
    own = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0)
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16]
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (key(r), digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = seq = tuple(own.get(head, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(str(c) for c in sorted(who) if full[c] == node).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def made(seed, convs=90, longest=7, kinds=3):
    g = random.Random(seed)
    return [
        (c, t, g.choice(["user", "bot"]), " ".join(g.choice("abc") for _ in range(g.randrange(kinds))))
        for c in range(-25, convs) for t in range(g.randrange(longest)) if c % 7
    ]


@pytest.mark.parametrize("seed,piece", [(1, 4096), (2, 2), (3, 3)])
def test_random_conversations(spark, seed, piece):
    rows = made(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(prefix_trie.trie(df, piece)) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (0, 0, "user", "hi there"), (0, 0, "user", "hi there"), (0, None, None, None), (1, None, None, None), (1, 0, "user", "hi there"),
        (1, 0, "user", "hi there"), (20, 1, "a", ""), (20, 1, "", "a"), (20, 1, "a", None), (None, 0, "user", "x"), (2, 5, "user", "w " * 50_000),
        (3, 5, "user", "w " * 50_000), (41, 0, "user", "only turn"), (-3, 0, "x", "y"), (2**62, 0, "x", "y"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    assert got(prefix_trie.trie(df)) == brute(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_many_children_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_PARENT", 4)
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 64)
    rows = [(c, t, "user", text) for c in range(120) for t, text in enumerate(["same start", f"own {c % 40}", "same end"])]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_fat_search_finds_the_plain_exit(spark):
    """Every located exit equals the one found by walking down prefix by prefix; small tries are given out in between."""
    g = random.Random(5)
    trie, seen = prefix_trie.ZFastTrie(), set()
    for _ in range(400):
        turns = [bytes([g.randrange(3)]) * 16 for _ in range(g.randrange(1, 40))]
        prefixes, h = [], prefix_trie.ROOT
        for t in turns:
            h = hashlib.sha256(h + t).digest()[:16]
            prefixes.append(h)
        path = prefix_trie.Path(0, prefix_trie.ROOT, prefixes, list(range(len(prefixes))), len(prefixes))
        if trie.roots:
            assert trie.locate(path)[2] == sum(p in seen for p in prefixes)
        trie.insert(path, 1, 1, 0)
        seen.update(prefixes)
    assert {r[0] for r in trie.expanded()} == seen | {prefix_trie.ROOT}
    assert all(trie.handles[n.path.at(prefix_trie.fattest(n.low, n.high))] is n for n in trie.nodes)


def test_small_tries(spark):
    rows = made(9)
    turns = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    pieces = prefix_trie.pieces(turns)
    sums = lambda df: sorted(map(tuple, df.groupBy("node", "depth").sum("n", "ended").collect()))
    assert sums(prefix_trie.shard_nodes(pieces, 5)) == sums(prefix_trie.shard_nodes(pieces))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.op13_z_fast_trie(spark, "/root/testdata/sf0.01")) == brute(rows)
