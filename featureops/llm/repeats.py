"""Passages of at least ``MIN_WORDS`` words that several documents share, from sparse suffix arrays.

1. Of each window of W = 31 neighbouring 20-word runs, the run with the least hash is a minimiser. A repeated
   passage of 50 words holds such a window, so its occurrences keep a common suffix start, which begins at
   most 30 words into it. One word position in sixteen is kept.
2. Positions whose 20 words occur in two documents go on, with a digest of their surroundings (30 words to
   the left, 50 to the right). Where two documents have the same surroundings, all of it is repeated; one
   position of each such group stays as a neighbour for others.
3. Each 50-word window belongs to the one minimiser it holds, the same in every occurrence. The windows of the
   remaining positions are grouped by a 64-bit hash, and those that stand in two documents are repeated; this is
   exact, whatever else surrounds them. Windows that overlap are joined, to passages of any length.

A window's group keeps its least and its greatest document only, so a very frequent passage costs two numbers a task.
Null, empty and short texts have no passages. Repeated rows (doc_id and text alike) count once; rows that share a
doc_id, or have none, are documents of their own if their texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from featureops.llm.common import scan, table, written
from featureops.llm.hashing import code_points, sequence_hashes, span_hashes, word_hashes

MIN_WORDS = 50
RUN = 20  # words that suffixes must share to be compared
LEFT = MIN_WORDS - RUN  # and the number of runs less one in a window
HOT = 4_096  # no longer used: no run is held as a whole


def owners(runs: np.ndarray, window: int = LEFT + 1) -> np.ndarray:
    """The position that has the least hash of each window; the leftmost of equal ones."""
    if len(runs) < window:
        return np.zeros(0, "i8")
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    return views.argmin(1) + np.arange(len(views))


def minimisers(runs: np.ndarray, window: int = LEFT + 1) -> np.ndarray:
    """Positions that have the least hash of one of the windows."""
    return np.unique(owners(runs, window))


def sparse_suffixes(rows: DataFrame) -> DataFrame:
    """run, around, doc, pos for the minimisers of each text; ``around`` is the surroundings' digest."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            out: dict[str, list] = {c: [] for c in ("run", "around", "doc", "pos")}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, _, _ = word_hashes(value.as_py())
                runs = sequence_hashes(words, RUN)
                at = minimisers(runs)
                if len(at):
                    out["run"].append(runs[at].view("i8"))
                    low, high = np.maximum(at - LEFT, 0), np.minimum(at + MIN_WORDS, len(words))
                    out["around"].append((span_hashes(words, low, high) + (at - low).astype("u8")).view("i8"))
                    out["doc"].append(np.full(len(at), doc))
                    out["pos"].append(at.astype("i4"))
            if out["run"]:
                yield {c: np.concatenate(v) for c, v in out.items()}

        return step

    return scan(rows.select("doc", "text"), make, "run long, around long, doc long, pos int")


def surroundings(rows: DataFrame) -> DataFrame:
    """doc, doc_id, text and marks (pos, partner, stays) -> doc, doc_id, window, low, high, first, last.

    A position whose surroundings have a partner gives them as one repeated stretch, without a hash. Of the others,
    and of those that stay as partners for them, come the windows that belong to the position."""

    def make() -> Any:
        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            if batch is None:
                return
            names = ("doc", "doc_id", "window", "low", "high", "first", "last")
            out: dict[str, list] = {c: [] for c in names}
            for doc, named, value, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text = value.as_py()
                words, starts, ends = word_hashes(text)
                starts, ends = code_points(text, starts), code_points(text, ends)
                shared = np.array([m["pos"] for m in marks if m["partner"] is not None], "i8")
                low, high = np.maximum(0, shared - LEFT), np.minimum(len(words), shared + MIN_WORDS)
                low, high = low[high - low >= MIN_WORDS], high[high - low >= MIN_WORDS]
                own = [m["pos"] for m in marks if m["partner"] is None or m["stays"]]
                at = np.flatnonzero(np.isin(owners(sequence_hashes(words, RUN)), own)) if own else np.zeros(0, "i8")
                hashes = sequence_hashes(words, MIN_WORDS)[at].view("i8").tolist() if len(at) else []
                low, high = np.concatenate([low, at]), np.concatenate([high, at + MIN_WORDS])
                n = len(low)
                for c, v in zip(names, ([doc] * n, [named] * n, [None] * (n - len(at)) + hashes, low.tolist(), high.tolist(), starts[low].tolist(), ends[high - 1].tolist())):
                    out[c] += v
            yield out

        return step

    return scan(rows, make, "doc long, doc_id long, window long, low int, high int, first int, last int")


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per repeated passage of a document: doc_id, start, end (code points, end exclusive), n_words.

    ``hot`` is kept for callers; the result never depended on it, and the plan no longer does."""
    # doc tells documents apart that share a doc_id or have none
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    suffixes = written(sparse_suffixes(rows), "repeats-suffixes")

    # stored: a join that follows its aggregation in one stage could not be split where a run is hot
    runs = suffixes.groupBy("run").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z").select("run")
    runs = written(runs, "repeats-runs")
    alive = written(suffixes.join(runs, "run"), "repeats-alive")
    same = alive.groupBy("run", "around").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z")
    # Two documents of each group stay, as one may be the document that looks for a partner.
    marked = alive.join(same, ["run", "around"], "left").select(
        "doc", "pos", F.when(F.col("a") == F.col("doc"), F.col("z")).otherwise(F.col("a")).alias("partner"), F.col("doc").isin(F.col("a"), F.col("z")).alias("stays"))
    marks = marked.groupBy("doc").agg(F.collect_list(F.struct("pos", "partner", "stays")).alias("marks"))
    # one exchange by doc serves both the repeated rows and the join
    held = rows.dropDuplicates(["doc"]).join(marks, "doc").select("doc", "doc_id", "text", "marks")
    found = written(surroundings(held), "repeats-windows")

    columns = ["doc", "doc_id", "low", "high", "first", "last"]
    windows = found.where("window is not null")
    # stored: a join that follows its aggregation in one stage could not be split where a window is hot
    twice = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z").select("window")
    twice = written(twice, "repeats-twice")
    matched = found.where("window is null").select(columns).union(windows.join(twice, "window").select(columns))

    # At most one row for each word of a document meets here.
    order = Window.partitionBy("doc", "doc_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = matched.withColumn("new", F.when(F.col("low") < reach, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "doc_id", "island").agg(
        F.min("first").alias("start"), F.max("last").alias("end"), (F.max("high") - F.min("low")).cast("long").alias("n_words"),
    ).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words")


def op10_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
