"""Counter rates, signals and rollback decisions on a stream of metric samples.

State of one series: samples that the watermark has not passed yet, one running summary (last sample, rank and
reset-corrected total), and the first and last sample of each chunk of the open windows. A chunk is the greatest
common divisor of window and step, so every window begins and ends at a chunk's edge: 20 chunks for windows of
five minutes every 15 seconds, however many samples there are. A timer closes the windows the watermark has passed,
for all series in the same micro-batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rates import by_metric, rate_value
from ..sources.metric_samples import series_key

ENDS = (
    "metric string, job string, namespace string, series string, eval_us bigint, n bigint, first_us bigint, "
    "first_v double, last_us bigint, last_v double, increase double"
)
ENTRIES = "array<struct<key:string,value:string>>"


def series_text() -> Column:
    """The labels in sorted order as one text: state keys are plain values."""
    return F.to_json(series_key()).alias("series")


def labels_of_text() -> Column:
    return F.map_from_entries(F.from_json("series", ENTRIES)).alias("labels")


class WindowEnds(StatefulProcessor):
    """First and last sample, count and increase of every closed window of one series."""

    def __init__(self, windows: Mapping[str, int], step_us: int, chunks: Mapping[str, int]) -> None:
        self.windows, self.step_us, self.chunks = dict(windows), step_us, dict(chunks)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us bigint, value double")
        self.edges = handle.getListState(
            "edges", "chunk bigint, first_us bigint, first_v double, first_total double, first_rank bigint, "
            "last_us bigint, last_v double, last_total double, last_rank bigint"
        )
        self.running = handle.getValueState("running", "value double, total double, rank bigint, due bigint")

    def _get(self) -> tuple:
        return tuple(self.running.get()) if self.running.exists() else (None, 0.0, 0, None)

    def _due(self, now: int | None, wanted: int | None) -> None:
        """Keep one timer, at the next evaluation that can see a sample."""
        if now != wanted:
            if now is not None:
                self.handle.deleteTimer(now // 1000)
            if wanted is not None:
                self.handle.registerTimer(wanted // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for frame in rows:
            frame = frame[frame["value"].notna() | frame["value_is_nan"]]
            if len(frame):
                self.pending.appendList([(int(u), float(v)) for u, v in zip(frame["us"], frame["value"])])
                low = int(frame["us"].min())
                earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            value, total, rank, due = self._get()
            first = -(-earliest // self.step_us) * self.step_us
            wanted = first if due is None else min(due, first)
            self._due(due, wanted)
            self.running.update((value, total, rank, wanted))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window, chunk = self.windows[key[0]], self.chunks[key[0]]
        value, total, rank, at = self._get()
        edges = {e[0]: list(e[1:]) for e in map(tuple, self.edges.get())}
        pending = sorted(map(tuple, self.pending.get()))
        closed, out, i = timerValues.getCurrentWatermarkInMs() * 1000, [], 0
        while at is not None and at < closed:
            while i < len(pending) and pending[i][0] <= at:
                us, v = pending[i]
                i += 1
                if rank:
                    total += v - value if v >= value else v
                value, rank = v, rank + 1
                edge = edges.setdefault(-(-us // chunk), [us, v, total, rank] * 2)
                edge[4:] = [us, v, total, rank]
            edges = {c: e for c, e in edges.items() if c * chunk > at - window}
            if edges:
                first, last = edges[min(edges)], edges[max(edges)]
                out.append((*key, at, last[7] - first[3] + 1, first[0], first[1], last[4], last[5], last[6] - first[2]))
            # the next evaluation that sees a chunk or a waiting sample
            if edges and max(edges) * chunk > at + self.step_us - window:
                at += self.step_us
            elif i < len(pending):
                at = max(at + self.step_us, -(-pending[i][0] // self.step_us) * self.step_us)
            else:
                at = None
        if at is None:
            for state in (self.pending, self.edges, self.running):
                state.clear()
        else:
            self.pending.put(pending[i:]) if i < len(pending) else self.pending.clear()
            self.edges.put([(c, *e) for c, e in sorted(edges.items())]) if edges else self.edges.clear()
            self.running.update((value, total, rank, at))
            self.handle.registerTimer(at // 1000)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDS.split(", ")])


def stream_window_ends(
    samples: DataFrame, windows: Mapping[str, int], step_us: int, watermark: str | None, chunks: Mapping[str, int] | None = None
) -> DataFrame:
    """(metric, job, namespace, labels, eval_ts, n, first_us, first_v, last_us, last_v, increase) of every closed window
    (t - w, t] with a sample, t being multiples of the step; append mode. Windows and steps are in microseconds.

    If the samples come from a windowed aggregate of the stream, ``ts`` must be its ``window_time`` and ``watermark``
    None: the one there is kept."""
    chunks = chunks or {m: math.gcd(w, step_us) for m, w in windows.items()}
    if any(w % chunks[m] or step_us % chunks[m] for m, w in windows.items()) or step_us % 1000:
        raise ValueError("chunk must divide window and step; steps are whole milliseconds")
    seen = samples.where(F.col("metric").isin(*windows))
    if watermark is not None:
        seen = seen.withWatermark("ts", watermark)
    rows = seen.select(
        "metric", "job", "namespace", series_text(), "ts", F.unix_micros("ts").alias("us"), "value", F.isnan("value").alias("value_is_nan")
    )
    ends = rows.groupBy("metric", "job", "namespace", "series").transformWithStateInPandas(
        WindowEnds(windows, step_us, chunks), ENDS, "append", "EventTime"
    )
    return ends.select(
        "metric", "job", "namespace", labels_of_text(), F.timestamp_micros("eval_us").alias("eval_ts"),
        "n", "first_us", "first_v", "last_us", "last_v", "increase",
    )


def stream_rates(
    samples: DataFrame, windows: Mapping[str, int], step_us: int, watermark: str | None, extrapolate: bool = True,
    chunks: Mapping[str, int] | None = None,
) -> DataFrame:
    """(metric, job, namespace, labels, eval_ts, rate, value) of closed windows: the rate is null with fewer than two
    samples, the value is the newest one."""
    ends = stream_window_ends(samples, windows, step_us, watermark, chunks)
    rate = rate_value(
        F.col("n"), F.col("first_us"), F.col("first_v"), F.col("last_us"), F.col("increase"),
        F.unix_micros("eval_ts"), by_metric(windows), extrapolate,
    )
    return ends.select("metric", "job", "namespace", "labels", "eval_ts", rate.alias("rate"), F.col("last_v").alias("value"))


def stream_counter_rates(
    counters: DataFrame,
    window_sec: int,
    step_sec: int,
    watermark: str | None,
    extrapolate: bool = True,
    chunk_sec: int | None = None,
) -> DataFrame:
    """(job, namespace, labels, eval_ts, rate) for each closed window (t - w, t] with two samples; append mode."""
    chunk = chunk_sec or math.gcd(window_sec, step_sec)
    one = counters.withColumn("metric", F.lit("counter"))
    rates = stream_rates(one, {"counter": window_sec * 1_000_000}, step_sec * 1_000_000, watermark, extrapolate, {"counter": chunk * 1_000_000})
    return rates.where(F.col("rate").isNotNull()).select("job", "namespace", "labels", "eval_ts", "rate")
