"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

1. Every page is read as a tree. Neighbours of one key (tag and name words) under one parent are a repeated group,
   and a group's place is the path of keys to it, each with its number among the groups of its key. Of each place of a
   host are counted, over all its pages: the text, the text in links, whether it is ever repeated, whether it holds a named
   article, the texts that stand there on every page that has the place, and whether three different pages have it. These
   are sums, unions and intersections: they are added up within tasks first, and neither the order nor the deal of rows
   matters. What comes out has sequences, optional and repeated groups and slots, and no alternatives.
2. A group outside the article is judged by what its place held: a text that stands there on all of three different
   pages or more is template, and so is a group that is mostly links; of a repeated group only the members of which this
   holds are. A group that holds a named article is none. The article is the group that says so, or the smallest
   with most of the differing text.
3. Every page is read by its host's wrapper: what it calls template is left out, and the blocks come from the article.

Null and empty pages have the empty text. Pages without url belong to a host of their own name. Repeated rows
each get a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureops.llm.common import scan, table, written
from featureops.llm.page_tree import Element, blocks, named_main, not_text, tree_of

SAME_PAGES = 3  # fewest different pages for a text to count as template because it never differs
MOST = 0.6  # share of the differing text that the article holds, where no name tells
CELLS = 250_000  # values of an alignment held at once
PIECES = 1_000  # parts that all pages are dealt in, where a host has more than one of them
DEPTH = 60  # deeper groups are judged by names only
HELD = 50_000  # places, and texts at them, held by a task before they are given out
FRAMES = frozenset("html body div section td table tbody tr center".split())  # what the article's group may be, where no name tells

Pattern = dict[str, Any]
Group = dict[str, Any]  # pages, text, links, many, holds, rank, members


def digest(piece: bytes) -> str:
    return hashlib.blake2b(piece, digest_size=10).hexdigest()


def measured(root: Element) -> dict[int, tuple[int, int, bytes, bool]]:
    """By element: characters of its text, those of them in links, what stands for its text, and whether it is or holds
    a named article. One pass from the leaves."""
    order, work = [], [root]
    while work:
        e = work.pop()
        order.append(e)
        work += e.elements()
    out: dict[int, tuple[int, int, bytes, bool]] = {}
    for e in reversed(order):
        size = links = 0
        holds = named_main(e) > 0
        pieces = []
        for c in e.children:
            if isinstance(c, str):
                if c := " ".join(c.split()):
                    size += len(c)
                    pieces.append(c.encode("utf-8", "surrogatepass"))
            else:
                more, linked_more, piece, named = out[id(c)]
                size, links, holds = size + more, links + linked_more, holds or named
                if piece:
                    pieces.append(piece)
        text = pieces[0] if len(pieces) == 1 else hashlib.blake2b(b"\0".join(pieces)).digest() if pieces else b""
        out[id(e)] = size, size if e.tag == "a" else links, text, holds
    return out


def runs(e: Element, place: str) -> Iterator[tuple[str, list[Element]]]:
    """The groups below an element: place and members."""
    seen: dict[str, int] = {}
    for key, members in groupby(e.elements(), lambda c: c.key):
        key = key if len(key) <= 100 else f"{key.split('.')[0][:50]}.{digest(key.encode('utf-8', 'surrogatepass'))}"
        n = seen[key] = seen.get(key, -1) + 1
        yield f"{place}/{key} {n}" if n else f"{place}/{key}", list(members)


def groups_of(page: str) -> Iterator[tuple[str, Group]]:
    """Place and count of each group of a page. What names leave out, and what stands in a named article, isn't looked into."""
    root = tree_of(page)
    known = measured(root)
    own = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
    size, links, _, _ = known[id(root)]
    yield "", {"pages": {own}, "text": size, "links": links, "many": False, "holds": False, "rank": 0, "members": set()}
    work = [(root, "", 0)]
    while work:
        e, place, depth = work.pop()
        for at, members in runs(e, place):
            if not_text(members[0], False):
                continue
            all_of = [known[id(m)] for m in members]
            rank = named_main(members[0])
            yield at, {
                "pages": {own}, "text": sum(x[0] for x in all_of), "links": sum(x[1] for x in all_of), "many": len(members) > 1,
                "holds": any(x[3] for x in all_of), "rank": rank, "members": {digest(x[2]) for x in all_of if x[2]}}
            if rank < 2 and depth + 1 < DEPTH:
                work += [(m, at, depth + 1) for m in members]


def added(a: Group, b: Group) -> None:
    """b is counted into a."""
    a["pages"] = set(sorted(a["pages"] | b["pages"])[:SAME_PAGES])  # the question is only whether there are so many
    a["members"] &= b["members"]
    a["text"] += b["text"]
    a["links"] += b["links"]
    a["many"] |= b["many"]
    a["holds"] |= b["holds"]


def common_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of x and the first 0, 1, ... of y."""
    row = np.zeros(len(y) + 1, "i4")
    for value in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == value)))
    return row


def pairing(x: list[Pattern], y: list[Pattern]) -> list[tuple[Pattern | None, Pattern | None]]:
    """Parts of both sides in common order, by a longest common subsequence of their keys. Long sides are halved
    where their halves have most in common, so that memory grows with their length only."""
    n, m = len(x), len(y)
    if n > 1 and n * m > CELLS:
        number: dict[str, int] = {}
        p, q = (np.array([number.setdefault(e["key"], len(number)) for e in side]) for side in (x, y))
        half = n // 2
        at = int(np.argmax(common_lengths(p[:half], q) + common_lengths(p[half:][::-1], q[::-1])[::-1]))
        return pairing(x[:half], y[:at]) + pairing(x[half:], y[at:])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i]["key"] == y[j]["key"] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[Pattern | None, Pattern | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i]["key"] == y[j]["key"]:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


def linked(text: int, links: int) -> bool:
    return text > 0 and links > 0.8 * text


def judged(groups: dict[str, Group]) -> dict[str, Any]:
    """The wrapper by a host's groups: ``rank`` of the names that say which group is the article, its place (``main``) where
    there is none, and by place what is template (``out``: digests, or None for all; ``links``: members that are mostly links)."""
    rank = max((g["rank"] for g in groups.values()), default=0)
    out: dict[str, Any] = {}
    gone: set[str] = set()
    for place in sorted(groups, key=lambda p: p.count("/")):
        g = groups[place]
        if place and place.rpartition("/")[0] in gone:
            gone.add(place)
        elif place.count("/") > 2 and g["text"] > 0 and not g["rank"] and not g["holds"]:
            same = sorted(g["members"]) if len(g["pages"]) >= SAME_PAGES else []
            links = linked(g["text"], g["links"])
            if not g["many"] and (same or links):
                out[place] = {"out": None}
                gone.add(place)
            elif same or links:
                out[place] = {"out": same, "links": links}
    at = ""
    differing = lambda p: groups[p]["text"] - groups[p]["links"]
    below: dict[str, list[str]] = {}
    for place in groups:
        if place and place not in gone and place.rpartition("/")[2].split(".")[0].split(" ")[0] in FRAMES:
            below.setdefault(place.rpartition("/")[0], []).append(place)
    while not rank and at in groups:  # the smallest group with most of the text
        inner = [p for p in below.get(at, ()) if differing(p) >= MOST * max(1, differing(at))]
        if len(inner) != 1 or groups[inner[0]]["many"]:
            break
        at = inner[0]
    return {"rank": rank, "main": "" if at.rpartition("/")[2].split(".")[0].split(" ")[0] in ("", "html", "body") else at, "out": out}


def inferred(pages: list[str]) -> str:
    """The judged wrapper of some pages of a host, as JSON."""
    groups: dict[str, Group] = {}
    for page in pages:
        for place, g in groups_of(page):
            if place in groups:
                added(groups[place], g)
            else:
                groups[place] = g
    return json.dumps(judged(groups), ensure_ascii=False) if groups else ""


def main_text(page: str, wrapper: dict[str, Any] | None) -> str:
    """Blocks of the article, by the wrapper where it knows the groups and by names elsewhere."""
    root = tree_of(page)
    mains: list[Element] = []
    ranks: dict[int, list[Element]] = {}
    skip: set[int] = set()
    known: dict[int, tuple[int, int, bytes, bool]] = {}
    placed = wrapper is not None and bool(wrapper["out"] or wrapper["main"])
    work: list[tuple[Element, str, int, bool]] = [(root, "", 0, False)]

    def template(e: Element, part: dict[str, Any]) -> bool:
        if part["out"] is None:
            return True
        if not known:
            known.update(measured(root))
        size, links, piece, _ = known[id(e)]
        return part["links"] and linked(size, links) or bool(piece) and digest(piece) in part["out"]

    while work:
        e, place, depth, inside = work.pop()
        after = []
        looked_up = placed and not inside and depth < DEPTH
        for at, members in runs(e, place) if looked_up else [("", list(e.elements()))]:
            part = wrapper["out"].get(at) if looked_up else None
            for c in members:
                if not_text(c, inside) or part and template(c, part):
                    skip.add(id(c))
                    continue
                now = inside
                rank = named_main(c)
                main = not inside and wrapper is not None and (0 < rank == wrapper["rank"] or at != "" and at == wrapper["main"])
                if not inside and (main or rank):
                    if main:
                        mains.append(c)
                    ranks.setdefault(rank, []).append(c)
                    now = rank == 2 or main
                after.append((c, at, depth + 1, now))
        work += after[::-1]
    top = max(ranks, default=0)
    chosen = ranks[2] if top == 2 else mains or ranks.get(top) or [root]
    order: list[Element] = []
    walk: list[Element] = [root]
    wanted = {id(c) for c in chosen}
    while walk:
        e = walk.pop()
        if id(e) in wanted:
            order.append(e)
        elif id(e) not in skip:
            walk += list(e.elements())[::-1]
    return "\n\n".join(t for e in order for t in blocks(e, frozenset(skip)))


def host() -> Any:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def counted(pages: DataFrame) -> DataFrame:
    """host, place and the counts of the groups there, added up within tasks."""

    def make() -> Any:
        held: dict[tuple[str, str], Group] = {}
        size = 0

        def out() -> Iterator[dict[str, Any]]:
            if held:
                yield {"host": [k[0] for k in held], "place": [k[1] for k in held]} | {
                    c: [sorted(g[c]) if c in ("pages", "members") else g[c] for g in held.values()] for c in ("pages", "text", "links", "many", "holds", "rank", "members")}
            held.clear()

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal size
            if batch is None:
                yield from out()
                return
            for where, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for place, g in groups_of(page.as_py()):
                    if (where, place) in held:
                        added(held[where, place], g)
                    else:
                        held[where, place] = g
                        size += 1 + len(g["members"])
                if size > HELD:
                    size = 0
                    yield from out()

        return step

    return scan(pages.select("host", "html"), make, "host string, place string, pages array<long>, text long, links long, many boolean, holds boolean, rank int, members array<string>")


def wrappers_of(pages: DataFrame) -> DataFrame:
    """host, wrapper, from all pages of each host. A host's rows come together only for the places that can matter to
    ``judged``: possible template, and groups with the share of the text that the way to the article has at least."""
    several = counted(pages.where("html is not null")).groupBy("host", "place").agg(
        F.collect_list("pages").alias("pages"), F.sum("text").alias("text"), F.sum("links").alias("links"), F.max("many").alias("many"),
        F.max("holds").alias("holds"), F.max("rank").alias("rank"), F.collect_list("members").alias("members"))
    groups = several.withColumns({
        "pages": F.slice(F.array_sort(F.array_distinct(F.flatten("pages"))), 1, SAME_PAGES),
        "members": F.reduce("members", F.col("members")[0], F.array_intersect)})
    groups = written(groups, "wrappers-groups")
    hosts = groups.groupBy("host").agg(F.max("rank").alias("top"), F.max(F.when(F.col("place") == "", F.col("text") - F.col("links"))).alias("all"))
    depth = F.length("place") - F.length(F.replace("place", F.lit("/"), F.lit("")))
    judge = ~F.col("holds") & (F.col("rank") == 0) & (depth > 2) & (F.col("text") > 0)
    template = judge & ((F.size("members") > 0) & (F.size("pages") >= SAME_PAGES) | (F.col("links") > 0.8 * F.col("text")))
    frame = (F.col("top") == 0) & (F.col("text") - F.col("links") >= 0.99 * F.pow(F.lit(MOST), depth) * F.col("all"))
    rows = groups.join(hosts, "host").where((F.col("place") == "") | template | frame)
    return rows.select("host", "top", "place", "pages", "text", "links", "many", "holds", "rank", "members").groupBy("host").applyInPandas(assembled, "host string, wrapper string")


def assembled(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's wrapper."""
    groups = {r["place"]: r | {"pages": set(r["pages"]), "members": set(r["members"])} for r in rows.to_dict("records")}
    groups[""]["rank"] = int(rows["top"].iloc[0])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(judged(groups), ensure_ascii=False)]})


def pieces(rows: DataFrame) -> DataFrame:
    """host, pieces: in how many parts a host's pages are dealt, for hosts with over 1 / ``PIECES`` of all pages. So
    there are fewer than ``PIECES`` rows, whatever the number of hosts."""
    counts = written(rows.groupBy("host").agg(F.count("*").alias("n")), "wrappers-hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * PIECES > total).select("host", F.ceil(F.col("n") * PIECES / F.lit(total)).alias("pieces"))


def extracted(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    hot = pieces(rows)
    rows = rows.join(F.broadcast(hot), "host", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("pieces")), F.lit(0)))
    # One wrapper of some KB for each host, or for each piece of a large one.
    wrappers = wrappers_of(rows).join(F.broadcast(hot), "host", "left")
    wrappers = wrappers.select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    both = rows.join(wrappers.hint("shuffle_hash"), ["host", "piece"], "left").select("page_id", "url", "html", "wrapper")

    def make() -> Any:
        known: dict[str, Any] = {}

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            out = []
            for page, wrapper in zip(batch.column(2), batch.column(3)):
                w = wrapper.as_py()
                if w not in known:
                    if len(known) > 500:
                        known.clear()
                    known[w] = json.loads(w) if w else None
                out.append(main_text(page.as_py() or "", known[w]))
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(t) for t in out]}

        return step

    return scan(both, make, "page_id long, url string, text string, n_chars long")


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
