"""Rollback decision, escalation of missing observations, and fleet convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.compare import above, below
from ..params import RollbackLimits

UNAVAILABLE = "OBSERVABILITY_"


def rollback_decision(signals: DataFrame, limits: RollbackLimits = RollbackLimits()) -> DataFrame:
    """Adds ``should_rollback``, ``reason`` and the limits to (min_up, ratio_5xx, rps_5xx, p95).

    The first rule that applies decides; all limits are strict and a NaN breaks none.
    """
    up, p95 = F.col("min_up"), F.col("p95")
    ratio, rps = F.col("ratio_5xx"), F.col("rps_5xx")
    if limits.missing_errors_as_zero:
        ratio, rps = F.coalesce(ratio, F.lit(0.0)), F.coalesce(rps, F.lit(0.0))
    rules: list[tuple[Column, bool, Column]] = [
        (up.isNull(), False, F.lit("OBSERVABILITY_UNAVAILABLE: up metric missing")),
        (
            below(up, limits.min_up),
            True,
            F.concat(F.lit("FASTAPI_UNHEALTHY: min(up)="), up.cast("string"), F.lit(f" < {limits.min_up}")),
        ),
        (ratio.isNull() | rps.isNull(), False, F.lit("OBSERVABILITY_PARTIAL: 5xx metrics missing")),
        (
            above(ratio, limits.max_5xx_ratio) & above(rps, limits.max_5xx_rps),
            True,
            F.format_string(
                f"ERROR_BUDGET_EXCEEDED: 5xx_ratio=%.6f (> {limits.max_5xx_ratio}), "
                f"5xx_rps=%.3f (> {limits.max_5xx_rps})",
                ratio,
                rps,
            ),
        ),
        (p95.isNull(), False, F.lit("OBSERVABILITY_PARTIAL: latency metric missing")),
        (
            above(p95, limits.max_p95_sec),
            True,
            F.format_string(f"LATENCY_TOO_HIGH: p95=%.6fs (> {limits.max_p95_sec}s)", p95),
        ),
    ]
    verdict: Column | None = None
    for condition, rollback, reason in rules:
        row = F.struct(F.lit(rollback).alias("should_rollback"), reason.alias("reason"))
        verdict = F.when(condition, row) if verdict is None else verdict.when(condition, row)
    ok = F.struct(F.lit(False).alias("should_rollback"), F.lit("OK").alias("reason"))
    return signals.withColumn("_verdict", verdict.otherwise(ok)).select(
        *signals.columns,
        "_verdict.*",
        *[
            F.lit(value).alias(name)
            for name, value in (
                ("limit_min_up", limits.min_up),
                ("limit_5xx_ratio", limits.max_5xx_ratio),
                ("limit_5xx_rps", limits.max_5xx_rps),
                ("limit_p95_sec", limits.max_p95_sec),
                ("error_window_sec", limits.error_window_sec),
                ("latency_window_sec", limits.latency_window_sec),
            )
        ],
    )


def escalation(
    outcomes: DataFrame,
    target: Sequence[str] = ("job", "namespace"),
    order: Sequence[str] = ("ts",),
    chunk_sec: int = 60,
    after: int = RollbackLimits.escalate_after,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Adds ``consecutive`` (unavailable outcomes in a row so far) and ``severity``.

    Needs columns target..., order... (first one a timestamp; together unique per target),
    should_rollback, reason; a row without target or time belongs to no history. A target's history is cut into time chunks: rows are ordered inside
    a chunk only, and the run a chunk starts with is carried over from chunk totals, so one task
    sees at most one chunk of one target, or one total per chunk of a target. ``carried``
    (target..., consecutive) holds the runs before the first row, for incremental use.
    """
    missing = ~F.col("should_rollback") & F.col("reason").startswith(UNAVAILABLE)
    placed = F.col(order[0]).isNotNull()
    for c in target:
        placed = placed & F.col(c).isNotNull()
    rows = outcomes.where(placed).select(
        "*",
        missing.alias("_missing"),
        F.floor(F.unix_micros(F.col(order[0])) / (chunk_sec * 1_000_000)).alias("_chunk"),
    )
    in_chunk = Window.partitionBy(*target, "_chunk").orderBy(*order)
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_missing"), 0).otherwise(1)).over(in_chunk))
    in_island = Window.partitionBy(*target, "_chunk", "_island").orderBy(*order)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_missing"), 1).otherwise(0)).over(in_island))

    # One row per (target, chunk): does the run go through, and how long is it at the end? The last
    # row is taken with all its columns, so that this branch and the rows below need the same
    # shuffle and Spark runs it once.
    others = [c for c in rows.columns if c not in (*target, *order, "_chunk", "_island", "_run")]
    last = F.max_by(F.struct("_run", *others), F.struct("_island", *order))
    chunks = rows.groupBy(*target, "_chunk").agg(F.max("_island").alias("_resets"), last["_run"].alias("_tail"))
    if carried is not None:
        start = carried.select(
            *target, F.lit(None).cast("bigint").alias("_chunk"), F.lit(0).cast("bigint").alias("_resets"),
            F.col("consecutive").cast("bigint").alias("_tail"),
        )
        chunks = chunks.unionByName(start)
    over_chunks = Window.partitionBy(*target).orderBy(F.col("_chunk").asc_nulls_first())
    chunks = chunks.withColumn("_group", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(over_chunks))
    through = Window.partitionBy(*target, "_group").orderBy(F.col("_chunk").asc_nulls_first())
    chunks = chunks.withColumn("_end_run", F.sum("_tail").over(through))
    carry = chunks.select(
        *target, "_chunk", F.coalesce(F.lag("_end_run").over(over_chunks), F.lit(0)).alias("_carry")
    ).where(F.col("_chunk").isNotNull())

    joined = rows.join(carry, [*target, "_chunk"], "left")
    run = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    severity = (
        F.when(~F.col("_missing"), F.when(F.col("should_rollback"), "rollback").otherwise("ok"))
        .when(F.col("consecutive") >= after, "critical")
        .otherwise("skipped")
    )
    return (
        joined.withColumn("consecutive", F.when(F.col("_missing"), run).otherwise(0).cast("bigint"))
        .withColumn("severity", severity)
        .select(*outcomes.columns, "consecutive", "severity")
    )


def fleet_convergence(
    observations: DataFrame, wanted: Column | int, min_pods: int = RollbackLimits.converge_min_pods
) -> DataFrame:
    """One row per (job, namespace): pods whose newest observation serves the wanted version.

    Input: job, namespace, pod, ts, served_version (text). An unreadable version is null and
    replaces an older good one; a missing pod name is "unknown".
    """
    text = F.trim(F.col("served_version").cast("string"))
    served = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    pods = (
        observations.withColumn("pod", F.coalesce(F.nullif("pod", F.lit("")), F.lit("unknown")))
        .groupBy("job", "namespace", "pod")
        .agg(F.max(F.struct("ts", served.alias("served"))).alias("at"))
    )
    wanted = wanted if isinstance(wanted, Column) else F.lit(wanted)
    return (
        pods.groupBy("job", "namespace")
        .agg(F.count("*").alias("pods"), F.count_if(F.col("at.served") == wanted).alias("ok_pods"))
        .withColumn("converged", F.col("ok_pods") >= min_pods)
    )
