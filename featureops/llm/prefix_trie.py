"""Prefix trie of conversations: Z-fast tries per shard, merged by prefix.

A turn is a 128-bit digest of role and text, a prefix a 128-bit chain of such digests, so a prefix stands for
one trie node wherever it is met. Each task inserts its conversations, a batch at a time, into compacted tries:
nodes are hashed at the prefix whose depth is the two-fattest number of their edge (the handle), and a
conversation finds its exit node by fat binary search over the depths. Edges are then expanded to single nodes,
and nodes of equal prefix are added up over all tasks. So a common first turn, or a conversation that is copied
a million times, leaves a task as one row per node.

Sums over subtrees need no walk over the levels: a node is owned by its smallest member, a conversation owns the
tail of its own path, and all but the owner contribute a turn's words to the nodes above it.

Rows without conv_id belong to no conversation and are left out; null role, text count as empty. Turns of equal
number are ordered by their digest; repeated rows are turns of their own. ``c % 20`` keeps the sign of c. A
conversation is sorted and chained in one task, as a stream; beyond ``PIECE`` turns it goes on as further pieces
that are inserted apart, below the prefix they continue. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from featureops.llm.common import scan, table, written

ROOT = bytes(16)
PIECE = 4_096  # turns of one insertion
TRIE_TURNS = 300_000  # turns that a task's trie holds before it is given out
RUN_BYTES = 1 << 16  # joined ids in one row
HOT_PARENT = 1_024  # children; lookups of such a parent are spread
SALTS = 64
FAMILY, HEADS = 20, 4  # conversations that share a beginning, and the number of lengths it may have
WORD = r"[^\x20\x09-\x0D]+"


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return (-1 << ((low ^ high).bit_length() - 1)) & high


class Path:
    """The prefixes of one piece below its anchor at ``depth``, with the words that come before each."""

    __slots__ = ("depth", "anchor", "prefixes", "before", "total")

    def __init__(self, depth: int, anchor: bytes, prefixes: list[bytes], before: list[int], total: int) -> None:
        self.depth, self.anchor, self.prefixes, self.before, self.total = depth, anchor, prefixes, before, total

    @property
    def end(self) -> int:
        return self.depth + len(self.prefixes)

    def at(self, depth: int) -> bytes:
        return self.prefixes[depth - self.depth - 1] if depth > self.depth else self.anchor

    def words_to(self, depth: int) -> int:
        """Words of the turns up to ``depth``."""
        k = depth - self.depth
        return self.before[k] if k < len(self.prefixes) else self.total


class Node:
    """Edge (low, high] of a compacted trie; ``stops`` pieces and ``ends`` conversations end at its lower end."""

    __slots__ = ("low", "high", "path", "parent", "stops", "ends", "least")

    def __init__(self, low: int, high: int, path: Path, parent: Node | None) -> None:
        self.low, self.high, self.path, self.parent = low, high, path, parent
        self.stops, self.ends, self.least = 0, 0, None

    def add(self, stops: int, ends: int, least: int) -> None:
        self.stops += stops
        self.ends += ends
        self.least = least if self.least is None else min(self.least, least)


class ZFastTrie:
    """Compacted tries, one below each anchor, in one table of handles."""

    def __init__(self) -> None:
        self.roots: dict[bytes, Node] = {}
        self.handles: dict[bytes, Node] = {}
        self.edges: dict[bytes, Node] = {}  # by the first prefix of the edge
        self.nodes: list[Node] = []
        self.turns = 0

    def locate(self, path: Path) -> tuple[Node, Node | None, int]:
        """Deepest node whose whole extent is a prefix of the path, the node whose edge the path leaves (if any),
        and the depth up to which path and trie agree."""
        node = self.roots[path.anchor]
        a, b, end = path.depth, path.end, path.end
        while a < b:
            f = fattest(a, b)
            found = self.handles.get(path.at(f))
            if found is None:
                b = f - 1
            elif found.high <= end and path.at(found.high) == found.path.at(found.high):
                node, a = found, found.high
            else:
                return node, found, self.agreed(found, path, f)
        edge = self.edges.get(path.at(a + 1)) if a < end else None
        return (node, None, a) if edge is None else (node, edge, self.agreed(edge, path, a + 1))

    @staticmethod
    def agreed(node: Node, path: Path, known: int) -> int:
        low, high = known, min(node.high, path.end)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.path.at(middle) == path.at(middle) else (low, middle - 1)
        return low

    def split(self, node: Node, depth: int) -> Node:
        """A node at ``depth`` of an edge; the rest of the edge hangs below it."""
        handle = fattest(node.low, node.high)
        upper = Node(node.low, depth, node.path, node.parent)
        node.low, node.parent = depth, upper
        self.edges[upper.path.at(upper.low + 1)] = upper
        self.edges[node.path.at(depth + 1)] = node
        if handle <= depth:
            self.handles[upper.path.at(handle)] = upper
            self.handles[node.path.at(fattest(depth, node.high))] = node
        else:
            self.handles[upper.path.at(fattest(upper.low, depth))] = upper
        self.nodes.append(upper)
        return upper

    def insert(self, path: Path, stops: int, ends: int, least: int) -> None:
        if path.anchor not in self.roots:
            self.roots[path.anchor] = Node(path.depth, path.depth, path, None)
        above, node, depth = self.locate(path)
        if node is not None:
            above = node if depth == node.high else self.split(node, depth)
        if depth < path.end:
            leaf = Node(depth, path.end, path, above)
            self.edges[path.at(depth + 1)] = leaf
            self.handles[path.at(fattest(depth, path.end))] = leaf
            self.nodes.append(leaf)
            self.turns += len(path.prefixes)
            above = leaf
        above.add(stops, ends, least)

    def expanded(self) -> Iterator[tuple[bytes, int, bytes | None, int, int, int, int, int]]:
        """(prefix, depth, parent prefix, members, smallest member, words, words of the path, ended) of every node."""
        members, least = {}, {}
        every = sorted([*self.roots.values(), *self.nodes], key=lambda n: n.high, reverse=True)
        for node in every:
            n = members[node] = members.get(node, 0) + node.stops
            known = [x for x in (least.get(node), node.least) if x is not None]
            least[node] = low = min(known)
            if node.parent is not None:
                members[node.parent] = members.get(node.parent, 0) + n
                least[node.parent] = min(low, least.get(node.parent, low))
            path = node.path
            for depth in range(node.low + 1, node.high + 1):
                done = path.words_to(depth)
                ended = node.ends if depth == node.high else 0
                yield path.at(depth), depth, path.at(depth - 1), n, low, done - path.words_to(depth - 1), done, ended
        for anchor, node in self.roots.items():
            if node.high == 0:
                yield anchor, 0, None, members[node], least[node], 0, 0, node.ends


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, turn_digest, words): the original turns in order, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("turn_digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return turns.select("conv", F.row_number().over(order).alias("place"), "turn_digest", "words")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation, to be ordered by place; a row at place 0 stands for the conversation itself.

    A family has at most 20 conversations and its beginning at most 3 turns, so the join can't grow."""
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    known = turns.where("place = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("head"), shared.alias("shared"))
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv", "head")
    lead = known.join(heads, "head").where("place <= shared").select("conv", "place", "turn_digest", "words")
    own = turns.where(F.col("place") > shared)
    marks = known.select("conv", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).alias("words"))
    return own.unionByName(lead).unionByName(marks)


PIECES = "conv long, depth long, anchor binary, prefixes array<binary>, before array<long>, total long, last boolean"


def pieces(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """Chained prefixes of each conversation, ``size`` turns a row."""
    names = ("conv", "depth", "anchor", "prefixes", "before", "total", "last")

    def make() -> Any:
        now: dict[str, Any] = {}

        def begin(conv: int, depth: int, anchor: bytes, total: int) -> None:
            now.update(conv=conv, depth=depth, anchor=anchor, prefixes=[], before=[], total=total, last=True)

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            out: dict[str, list] = {n: [] for n in names}

            def close(last: bool) -> None:
                for n in names:
                    out[n].append(last if n == "last" else now[n])

            for conv, place, digest, words in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else ():
                if place == 0:
                    if now:
                        close(True)
                    begin(conv, 0, ROOT, 0)
                    continue
                if len(now["prefixes"]) == size:
                    close(False)
                    begin(conv, now["depth"] + size, now["prefixes"][-1], now["total"])
                above = now["prefixes"][-1] if now["prefixes"] else now["anchor"]
                now["prefixes"].append(hashlib.sha256(above + digest).digest()[:16])
                now["before"].append(now["total"])
                now["total"] += words
            if batch is None and now:
                close(True)
            yield out

        return step

    ordered = turns.select("conv", "place", "turn_digest", "words").repartition("conv").sortWithinPartitions("conv", "place")
    return scan(ordered, make, PIECES)


def shard_nodes(rows: DataFrame, hold: int = TRIE_TURNS) -> DataFrame:
    """Nodes of each task's tries; the same prefix comes from every task that met it."""
    names = ("node", "depth", "parent", "n", "least", "words", "path_words", "ended")

    def make() -> Any:
        trie = ZFastTrie()

        def given() -> Iterator[dict[str, Any]]:
            nonlocal trie
            out: dict[str, list] = {n: [] for n in names}
            for row in trie.expanded():
                for n, value in zip(names, row):
                    out[n].append(value)
                if len(out["node"]) >= 20_000:
                    yield out
                    out = {n: [] for n in names}
            trie = ZFastTrie()
            yield out

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                yield from given()
                return
            equal: dict[bytes, list] = {}  # one insertion for all equal pieces of the batch
            for conv, depth, anchor, prefixes, before, total, last in zip(*(c.to_pylist() for c in batch.columns)):
                got = equal.setdefault(prefixes[-1] if prefixes else anchor, [None, 0, 0, conv])
                got[0] = got[0] or Path(depth, anchor, prefixes, before, total)
                got[1:] = got[1] + 1, got[2] + last, min(got[3], conv)
            for path, stops, ends, least in equal.values():
                trie.insert(path, stops, ends, least)
                if trie.turns >= hold:
                    yield from given()

        return step

    schema = "node binary, depth long, parent binary, n long, least long, words long, path_words long, ended long"
    return scan(rows.select("conv", "depth", "anchor", "prefixes", "before", "total", "last"), make, schema)


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): ids of the conversations that end there, in ascending order.

    Ids are joined to runs in ranges of the id first; the digest then reads the runs of a node one after the other."""
    ends = rows.where("last").select("conv", F.coalesce(F.try_element_at("prefixes", F.lit(-1)), "anchor").alias("node"))

    def join() -> Any:
        runs: dict[bytes, list[int]] = {}
        held = 0

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal held
            full = []
            for conv, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if batch is not None else ():
                run = runs.setdefault(node, [])
                run.append(conv)
                held += 1
                if len(run) * 8 >= RUN_BYTES:
                    full.append((node, runs.pop(node)))
            if batch is None or held >= 500_000:
                full += runs.items()
                held = 0
                runs.clear()
            yield {"node": [n for n, _ in full], "first": [r[0] for _, r in full], "ids": [",".join(map(str, r)) for _, r in full]}

        return step

    def digest() -> Any:
        now: list[Any] = []

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            done: list[tuple[bytes, str]] = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if batch is not None else ():
                if now and now[0] == node:
                    now[1].update(b"," + ids.encode())
                    continue
                if now:
                    done.append((now[0], now[1].hexdigest()))
                now[:] = node, hashlib.sha256(ids.encode())
            if batch is None and now:
                done.append((now[0], now[1].hexdigest()))
            yield {"node": [n for n, _ in done], "ends_sha256": [d for _, d in done]}

        return step

    runs = scan(ends.repartitionByRange("conv").sortWithinPartitions("conv"), join, "node binary, first long, ids string")
    ordered = runs.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return scan(ordered, digest, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the prefix itself as ``node``."""
    rows = written(pieces(rebuilt_turns(written(numbered_turns(conversations), "trie-turns")), piece), "trie-pieces")
    fixed = ("node", "depth", "parent", "words", "path_words")
    nodes = written(
        shard_nodes(rows).groupBy(*fixed).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ended").alias("ended")),
        "trie-nodes",
    )
    # What a conversation adds to the nodes above: the words of its turns down to the first node it owns, and a leaf.
    owners = nodes.groupBy(F.col("least").alias("conv")).agg(
        F.min(F.col("path_words") - F.col("words")).alias("bound"), F.max((F.col("ended") == F.col("n")).cast("int")).alias("leaf")
    )
    shares = rows.where("last").select("conv", "total").join(owners, "conv", "left").select(
        "conv", F.coalesce("bound", "total").alias("bound"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    at_root = F.col("depth") == 0
    on_path = F.arrays_zip(
        F.when(at_root, F.concat(F.array(F.lit(ROOT)), "prefixes")).otherwise(F.col("prefixes")).alias("node"),
        F.when(at_root, F.concat(F.array(F.lit(0).cast("long")), "before")).otherwise(F.col("before")).alias("before"),
    )
    zero = F.lit(0).cast("long")
    added = (
        rows.select("conv", on_path.alias("path")).join(shares, "conv").where("bound > 0 OR leaf > 0")
        .select(F.inline("path"), "bound", "leaf")
        .select("node", F.greatest(zero, F.col("bound") - F.col("before")).alias("saved_tokens"), F.col("leaf").cast("long").alias("n_leaves"))
        .where("saved_tokens > 0 OR n_leaves > 0")
    )
    parts = nodes.select("node", F.col("least").alias("conv_id"), "depth", F.col("n").alias("n_convs"))
    born = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_children"))
    together = parts.unionByName(born, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)
    facts = written(
        together.groupBy("node").agg(
            *(F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs")),
            *(F.coalesce(F.sum(c), zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
        ),
        "trie-facts",
    )
    # Parents are looked up by (parent, salt) where they have many children, else by parent.
    parents = facts.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    links = nodes.where("parent IS NOT NULL").select("node", "parent", salt)
    hot = parents.where(F.col("n_children") >= HOT_PARENT).select(
        "parent", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("parent_conv_id").alias("hot_conv_id")
    )
    asked = links.join(hot, ["parent", "salt"], "left")
    found = asked.where("hot_conv_id IS NOT NULL").select("node", F.col("hot_conv_id").alias("parent_conv_id")).unionByName(
        asked.where("hot_conv_id IS NULL").join(parents.where(F.col("n_children") < HOT_PARENT), "parent").select("node", "parent_conv_id")
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return facts.join(found, "node", "left").join(end_digests(rows), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"), "node",
    )


def op13_z_fast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("node")
