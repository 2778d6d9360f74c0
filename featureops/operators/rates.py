"""Counter rates, error ratio, latency quantile and gauge minima on a grid of evaluation times.

The grid is cut into groups of evaluations that span several windows. A sample is sent once to the group of the
evaluations that can see it (a second time near a group's edge), and ordered there within its series. Running
totals (rank and reset-corrected increase) then belong to each sample, and the gaps to its neighbours say for
which evaluations it is the first or the last sample of the window. So a window's increase is a difference of two
totals: nothing is copied to the windows that overlap, whatever their length and step, and there is one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parse import number_or_null
from ..params import LATENCY_METRIC, REQUESTS_METRIC, UP_METRIC, EvalGrid
from ..sources.metric_samples import SERIES, label_matches, select_metric, series_key, series_labels

ERROR_STATUS = "5.."
GROUP_WINDOWS = 8  # windows that a group of evaluations spans; one sample in so many is sent twice


def _increase(previous: Column, value: Column) -> Column:
    """Increase of a counter between neighbours, null without one; a drop is a restart from zero."""
    return F.when(value >= previous, value - previous).when(previous.isNotNull(), value)


def first_evaluation(us: Column, grid: EvalGrid) -> Column:
    """Number of the first evaluation at or after an instant (epoch microseconds); may lie outside the grid."""
    past = us - grid.start_us + (grid.step_us - 1)
    return ((past - F.pmod(past, F.lit(grid.step_us))) / grid.step_us).cast("bigint")


def eval_time(number: Column, grid: EvalGrid) -> Column:
    return F.timestamp_micros(F.lit(grid.start_us) + number * grid.step_us)


def per_group(window_us: int, grid: EvalGrid) -> int:
    return max(1, -(-GROUP_WINDOWS * window_us // grid.step_us))


def by_metric(values: Mapping[str, int]) -> Column:
    """The value of a row's metric."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("metric")].cast("bigint")


def dealt(samples: DataFrame, grid: EvalGrid, windows: Mapping[str, int]) -> DataFrame:
    """Samples of the metrics named, with the evaluations (``_from`` to ``_to``) of their group that can see them."""
    us = F.unix_micros("ts")
    window = by_metric(windows)
    seen = samples.where(F.col("metric").isin(*windows) & F.col("value").isNotNull()).select(
        "metric", "job", "namespace", series_key(), us.alias("_us"), "value", window.alias("_window"),
        by_metric({m: per_group(w, grid) for m, w in windows.items()}).alias("_per"),
        F.greatest(F.lit(0).cast("bigint"), first_evaluation(us, grid)).alias("_first"),
        F.least(F.lit(grid.last).cast("bigint"), first_evaluation(us + window, grid) - 1).alias("_last"),
    ).where("_first <= _last")
    group = F.explode(F.sequence(F.floor(F.col("_first") / F.col("_per")), F.floor(F.col("_last") / F.col("_per"))))
    begin = F.col("_group") * F.col("_per")
    return seen.withColumn("_group", group).withColumns({
        "_from": F.greatest("_first", begin), "_to": F.least(F.col("_last"), begin + F.col("_per") - 1)
    }).drop("_first", "_last", "_per")


def window_ends(samples: DataFrame, grid: EvalGrid, windows: Mapping[str, int]) -> DataFrame:
    """(metric, job, namespace, series, k, n, first_us, first_v, last_us, last_v, increase) for every evaluation k
    and every series with a sample in the window (t - w, t] of its metric."""
    key = ("metric", *SERIES, "_group")
    in_order = Window.partitionBy(*key).orderBy("_us", "value")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(samples, grid, windows).withColumns({
        "_prev_us": F.lag("_us").over(in_order), "_next_us": F.lead("_us").over(in_order),
        "_rank": F.row_number().over(in_order).cast("bigint"),
        "_step": F.coalesce(_increase(F.lag("value").over(in_order), F.col("value")), F.lit(0.0)),
    }).withColumn("_total", F.sum("_step").over(so_far))
    # last sample of the evaluations before the next sample, first sample of those whose window leaves out the one before
    until = F.least(F.col("_to"), F.coalesce(first_evaluation(F.col("_next_us"), grid) - 1, F.col("_to")))
    since = F.greatest(F.col("_from"), F.coalesce(first_evaluation(F.col("_prev_us") + F.col("_window"), grid), F.col("_from")))

    def roles(low: Column, high: Column, is_last: bool) -> Column:
        marked = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), F.lit(is_last).alias("is_last")))
        return F.when(low <= high, marked).otherwise(F.array().cast("array<struct<k:bigint,is_last:boolean>>"))

    ends = placed.select("*", F.inline(F.concat(roles(F.col("_from"), until, True), roles(since, F.col("_to"), False))))
    at = lambda c, is_last: F.max(F.when(F.col("is_last") == is_last, F.col(c)))
    # grouped within the partitioning of the window above: no further exchange
    return ends.groupBy(*key, "k").agg(
        at("_us", False).alias("first_us"), at("value", False).alias("first_v"), at("_us", True).alias("last_us"),
        at("value", True).alias("last_v"), (at("_rank", True) - at("_rank", False) + 1).alias("n"),
        (at("_total", True) - at("_total", False)).alias("increase"),
    ).drop("_group")


def rate_value(
    n: Column, first_us: Column, first_v: Column, last_us: Column, increase: Column,
    eval_us: Column, window_us: int | Column, extrapolate: bool,
) -> Column:
    """Per-second rate of one window, null with fewer than two samples.

    With ``extrapolate`` the increase is stretched toward the window ends: all the way if the
    gap is under 1.1 average sample distances, else by half a distance, and at the start never
    beyond the point where the counter would have been zero.
    """
    window_sec = window_us / 1e6
    if not extrapolate:
        return F.when(n >= 2, increase / window_sec)
    span = (last_us - first_us) / 1e6
    gap = span / (n - 1)
    to_start = (first_us - (eval_us - window_us)) / 1e6
    to_end = (eval_us - last_us) / 1e6
    to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    to_zero = F.when((increase > 0) & (first_v >= 0), span * (first_v / increase))
    to_start = F.least(to_start, to_zero)
    to_end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
    return F.when((n >= 2) & (span > 0), increase * ((span + to_start + to_end) / span) / window_sec)


def rated(ends: DataFrame, grid: EvalGrid, windows: Mapping[str, int], extrapolate: bool) -> DataFrame:
    """``window_ends`` with their rate and evaluation time; windows with fewer than two samples have a null rate."""
    eval_us = F.lit(grid.start_us) + F.col("k") * grid.step_us
    rate = rate_value(
        F.col("n"), F.col("first_us"), F.col("first_v"), F.col("last_us"), F.col("increase"), eval_us, by_metric(windows), extrapolate
    )
    return ends.withColumns({"rate": rate, "eval_ts": F.timestamp_micros(eval_us)})


def counter_rates(counters: DataFrame, grid: EvalGrid, window_us: int, extrapolate: bool = True) -> DataFrame:
    """(job, namespace, labels, eval_ts, rate): no row for a window with fewer than two samples."""
    one = counters.withColumn("metric", F.lit("counter"))
    windows = {"counter": window_us}
    rows = rated(window_ends(one, grid, windows), grid, windows, extrapolate).where(F.col("rate").isNotNull())
    return rows.select("job", "namespace", series_labels(), "eval_ts", "rate")


EXACT = "decimal(38,30)"  # a rate below 1e8 with up to 30 digits after the point


def rate_sum(rate: Column) -> Column:
    """Sum of rates that doesn't depend on the order of its rows.

    A sum of doubles does, in its last digits, and a signal that lies on a limit would be judged by chance. Decimals add
    up to the same in any order; where they don't hold all rates, the doubles are added."""
    exact = rate.try_cast(EXACT)
    held = F.when(exact.cast("double") == rate, exact)
    whole = F.when(F.count(held) == F.count(rate), F.try_sum(held).cast("double"))
    return F.coalesce(whole, F.sum(rate))


def error_signals(rates: DataFrame) -> DataFrame:
    """(job, namespace, eval_ts, total_rps, rps_5xx, ratio_5xx) from request rates by status.

    Without any 5xx series the error columns are null, not 0. Below one request per second the
    ratio divides by 1.
    """
    failed = F.when(label_matches("status", ERROR_STATUS), F.col("rate"))
    sums = rates.groupBy("job", "namespace", "eval_ts").agg(
        rate_sum(F.col("rate")).alias("total_rps"), rate_sum(failed).alias("rps_5xx")
    )
    return sums.withColumn("ratio_5xx", F.col("rps_5xx") / F.greatest(F.col("total_rps"), F.lit(1.0)))


def latency_quantile(rates: DataFrame, q: float = 0.95) -> DataFrame:
    """(job, namespace, eval_ts, p95) from bucket rates by ``le``, linear inside the bucket.

    NaN without a +Inf bucket, with fewer than two buckets or without traffic; a rank in the
    +Inf bucket gives the highest finite bound.
    """
    key = ("job", "namespace", "eval_ts")
    by_le = (
        rates.withColumn("le", number_or_null(F.col("labels")["le"]))
        .where(F.col("le").isNotNull() & ~F.isnan("le"))
        .groupBy(*key, "le")
        .agg(rate_sum(F.col("rate")).alias("rate"))
    )
    return quantile_of_buckets(by_le, key, q)


def quantile_of_buckets(by_le: DataFrame, key: tuple[str, ...], q: float, others: Sequence[Column] = ()) -> DataFrame:
    """One row per key from (key..., le, rate); a key has as many rows as the histogram has bounds.

    A row without ``le`` is no bucket; a key with no bucket at all has a null. ``others`` are further aggregates."""
    ordered = Window.partitionBy(*key).orderBy("le")
    whole = Window.partitionBy(*key)
    inf = F.lit(float("inf"))
    seen = by_le.withColumn("cum", F.max("rate").over(ordered))  # bounds must not decrease
    seen = (
        seen.withColumn("prev_le", F.lag("le").over(ordered))
        .withColumn("prev_cum", F.lag("cum").over(ordered))
        .withColumn("total", F.max("cum").over(whole))
    )
    rank = F.col("total") * q
    base = F.coalesce("prev_cum", F.lit(0.0))
    start = F.coalesce("prev_le", F.lit(0.0))
    inside = F.when(F.col("prev_le").isNull() & (F.col("le") <= 0), F.col("le")).otherwise(
        start + (F.col("le") - start) * ((rank - base) / F.nullif(F.col("cum") - base, F.lit(0.0)))
    )
    # a zero rank falls into an empty first bucket: 0/0
    inside = F.coalesce(inside, F.lit(float("nan")))
    hit = (F.col("le") < inf) & (F.col("cum") >= rank)
    found = seen.groupBy(*key).agg(
        F.min(F.when(hit, F.struct("le", inside.alias("v")))).alias("hit"),
        F.max(F.when(F.col("le") < inf, F.col("le"))).alias("top"),
        F.max("le").alias("last_le"),
        F.count("le").alias("bounds"),
        F.max("total").alias("total"),
        *others,
    )
    usable = (F.col("last_le") == inf) & (F.col("bounds") >= 2) & (F.col("total") > 0)
    value = F.when(F.col("bounds") > 0, F.when(usable, F.coalesce("hit.v", "top")).otherwise(F.lit(float("nan"))))
    return found.select(*[c for c in found.columns if c not in ("hit", "top", "last_le", "bounds", "total")], value.alias("p95"))


def newest_in_lookback(gauges: DataFrame, grid: EvalGrid, lookback_us: int) -> DataFrame:
    """(job, namespace, labels, eval_ts, value): each series' newest sample in (t - lookback, t]."""
    ends = window_ends(gauges.withColumn("metric", F.lit("gauge")), grid, {"gauge": lookback_us})
    return ends.select("job", "namespace", series_labels(), eval_time(F.col("k"), grid).alias("eval_ts"), F.col("last_v").alias("value"))


def min_up(samples: DataFrame, grid: EvalGrid, lookback_us: int) -> DataFrame:
    newest = newest_in_lookback(select_metric(samples, UP_METRIC), grid, lookback_us)
    return newest.groupBy("job", "namespace", "eval_ts").agg(F.min("value").alias("min_up"))


def request_rates(samples: DataFrame, grid: EvalGrid, window_us: int, extrapolate: bool = True) -> DataFrame:
    return counter_rates(select_metric(samples, REQUESTS_METRIC), grid, window_us, extrapolate)


def bucket_rates(samples: DataFrame, grid: EvalGrid, window_us: int, extrapolate: bool = True) -> DataFrame:
    return counter_rates(select_metric(samples, LATENCY_METRIC), grid, window_us, extrapolate)


def series_present(
    targets: DataFrame, samples: DataFrame, metric: str, grid: EvalGrid, lookback_us: int
) -> DataFrame:
    """Targets x evaluation times with ``present``: has the metric any sample in the lookback?

    Samples are reduced, before the exchange, to the first evaluation that sees them: at most one row per target
    and evaluation. A row then covers the evaluations up to the next one's."""
    us = F.unix_micros("ts")
    first, last = first_evaluation(us, grid), first_evaluation(us + lookback_us, grid) - 1
    spans = (
        select_metric(samples, metric)
        .select("job", "namespace", F.greatest(F.lit(0).cast("bigint"), first).alias("first"), F.least(F.lit(grid.last).cast("bigint"), last).alias("last"))
        .where("first <= last")
        .groupBy("job", "namespace", "first")
        .agg(F.max("last").alias("last"))
    )
    after = F.lead("first").over(Window.partitionBy("job", "namespace").orderBy("first"))
    own = spans.withColumn("last", F.least(F.col("last"), F.coalesce(after - 1, F.col("last"))))
    seen = own.select("job", "namespace", F.explode(F.sequence("first", "last")).alias("k"))
    seen = seen.select("job", "namespace", eval_time(F.col("k"), grid).alias("eval_ts"), F.lit(1).alias("seen"))
    asked = on_grid(targets, grid).withColumn("seen", F.lit(0))
    return (
        asked.unionByName(seen)
        .groupBy("job", "namespace", "eval_ts")
        .agg(F.max("seen").alias("_max"), F.min("seen").alias("_min"))
        .where(F.col("_min") == 0)
        .select("job", "namespace", "eval_ts", (F.col("_max") == 1).alias("present"))
    )


def on_grid(targets: DataFrame, grid: EvalGrid) -> DataFrame:
    """(job, namespace, eval_ts) for every target and evaluation time."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid.last).cast("bigint"))).alias("k")
    return targets.select("job", "namespace", k).select("job", "namespace", eval_time(F.col("k"), grid).alias("eval_ts"))


def target_signals(
    targets: DataFrame,
    samples: DataFrame,
    grid: EvalGrid,
    error_window_us: int,
    latency_window_us: int,
    lookback_us: int,
    extrapolate: bool = True,
) -> DataFrame:
    """One row per target and evaluation time: min_up, ratio_5xx, rps_5xx, p95; null where unknown.

    The samples are read once: the metric is part of the series' key, each with its own window.
    """
    windows = {REQUESTS_METRIC: error_window_us, LATENCY_METRIC: latency_window_us, UP_METRIC: lookback_us}
    ends = rated(window_ends(samples, grid, windows), grid, windows, extrapolate)
    return asked_signals(
        on_grid(targets, grid),
        signals_of_rates(ends.select("metric", "job", "namespace", series_labels(), "eval_ts", "rate", F.col("last_v").alias("value"))),
    )


def asked_signals(asked: DataFrame, signals: DataFrame) -> DataFrame:
    """A row for every (job, namespace, eval_ts) asked, with its signals or nulls."""
    return (
        asked.withColumn("_asked", F.lit(True)).unionByName(signals, allowMissingColumns=True)
        .groupBy("job", "namespace", "eval_ts")
        .agg(F.max("_asked").alias("_asked"), *[F.max(v).alias(v) for v in SIGNALS])
        .where("_asked")
        .select("job", "namespace", "eval_ts", *SIGNALS)
    )


SIGNALS = ("min_up", "ratio_5xx", "rps_5xx", "p95")


def signals_of_rates(rates: DataFrame) -> DataFrame:
    """(job, namespace, eval_ts, min_up, ratio_5xx, rps_5xx, p95) from (metric, job, namespace, labels, eval_ts, rate,
    value) of all three metrics: sums by bucket bound first, then one row per target and time."""
    key = ("job", "namespace", "eval_ts")
    of = lambda metric, c: F.when(F.col("metric") == metric, F.col(c))
    le = number_or_null(F.col("labels")["le"])
    bounded = (F.col("metric") != LATENCY_METRIC) | (le.isNotNull() & ~F.isnan(le))
    known = (F.col("metric") == UP_METRIC) | F.col("rate").isNotNull()
    sums = (
        rates.where(bounded & known)
        .groupBy(*key, F.when(F.col("metric") == LATENCY_METRIC, le).alias("le"))
        .agg(
            F.min(of(UP_METRIC, "value")).alias("min_up"),
            rate_sum(of(REQUESTS_METRIC, "rate")).alias("total_rps"),
            rate_sum(F.when(label_matches("status", ERROR_STATUS), of(REQUESTS_METRIC, "rate"))).alias("rps_5xx"),
            rate_sum(of(LATENCY_METRIC, "rate")).alias("rate"),
        )
    )
    # the row without a bound holds the other metrics
    ratio = F.col("rps_5xx") / F.greatest(F.col("total_rps"), F.lit(1.0))
    others = [F.max("min_up").alias("min_up"), F.max(ratio).alias("ratio_5xx"), F.max("rps_5xx").alias("rps_5xx")]
    return quantile_of_buckets(sums, key, 0.95, others).select(*key, *SIGNALS)
