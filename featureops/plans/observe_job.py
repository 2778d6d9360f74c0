"""Metric samples to rollback decisions, one row per target and evaluation time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rates import target_signals
from ..operators.slo import escalation, rollback_decision
from ..params import EvalGrid, RollbackLimits


def observe(
    targets: DataFrame,
    samples: DataFrame,
    grid: EvalGrid,
    limits: RollbackLimits = RollbackLimits(),
    extrapolate: bool = True,
) -> DataFrame:
    signals = target_signals(
        targets,
        samples,
        grid,
        limits.error_window_sec * 1_000_000,
        limits.latency_window_sec * 1_000_000,
        limits.lookback_sec * 1_000_000,
        extrapolate,
    )
    return rollback_decision(signals, limits)


def observe_with_escalation(
    targets: DataFrame, samples: DataFrame, grid: EvalGrid, limits: RollbackLimits = RollbackLimits()
) -> DataFrame:
    decisions = observe(targets, samples, grid, limits)
    return escalation(decisions, order=("eval_ts",), after=limits.escalate_after)
