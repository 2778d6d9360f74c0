"""Per-entity features, the rule label, batch quality, and alignment with a contract."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.compare import at_least, at_most
from ..params import LABEL_COL, TIME_COL, LabelRule, QualityLimits
from ..session import epoch_us, instant_lit


def rule_label(events: Column, avg_sec: Column, rule: LabelRule = LabelRule()) -> Column:
    """2 = active, 0 = inactive, 1 = between. A NaN average meets neither session limit."""
    active = (events >= rule.high_min_events) & at_least(avg_sec, rule.high_min_avg_sec)
    inactive = (events <= rule.low_max_events) | at_most(avg_sec, rule.low_max_avg_sec)
    return F.when(active, 2).when(inactive, 0).otherwise(1)


EXACT = "decimal(38,18)"


def session_totals(value: str = "session_sec") -> list[Column]:
    """Mergeable totals of a column of doubles: ``_cnt`` values, their sum, and the same in decimals over ``_held`` of them.

    A sum of doubles depends on the order of its rows, so an average that meets a limit exactly would be
    labelled by chance. Decimals add up to the same in any order; they hold values below 1e20 of up to 18 digits after the point.
    """
    c = F.col(value)
    exact = c.try_cast(EXACT)
    held = F.when(exact.cast("double") == c, exact)
    return [F.count(value).alias("_cnt"), F.sum(value).alias("_sum"), F.count(held).alias("_held"), F.try_sum(held).alias("_exact")]


def session_sum() -> Column:
    """The sum of ``session_totals``: exact where the decimals hold all values, else the sum of the doubles."""
    return F.coalesce(F.when(F.col("_held") == F.col("_cnt"), F.col("_exact").cast("double")), F.col("_sum"))


def feature_columns(
    events: Column, session_sum: Column, session_count: Column, last_time: Column, as_of_us: Column
) -> list[Column]:
    """The three features from mergeable totals (also used by the streaming form)."""
    avg_sec = F.coalesce(session_sum / F.nullif(session_count, F.lit(0)), F.lit(0.0))
    age_sec = (as_of_us - F.unix_micros(last_time)) / 1e6
    return [
        events.alias("f_total_events_7d"),
        avg_sec.alias("f_avg_session_sec_7d"),
        F.coalesce(age_sec.cast("bigint"), F.lit(0)).alias("f_last_event_age_sec"),
    ]


def entity_features(
    events: DataFrame,
    as_of: datetime | str | int,
    entity: Sequence[str] = ("user_id",),
    rule: LabelRule = LabelRule(),
    window_days: int | None = None,
) -> DataFrame:
    """One row per entity from (entity..., session_sec, event_time).

    All aggregates are algebraic, so each task reduces its rows before the only shuffle and a
    hot entity costs one row per task. Without ``window_days`` all rows count, whatever the
    feature names say.
    """
    as_of_us = epoch_us(as_of)
    if window_days is not None:
        first = instant_lit(as_of_us - window_days * 86_400_000_000)
        events = events.where((F.col("event_time") > first) & (F.col("event_time") <= instant_lit(as_of_us)))
    totals = events.groupBy(*entity).agg(
        F.count("*").alias("_n"),
        *session_totals(),
        F.max("event_time").alias("_last"),
    )
    features = totals.select(
        *entity,
        *feature_columns(F.col("_n"), session_sum(), F.col("_cnt"), F.col("_last"), F.lit(as_of_us)),
    )
    return features.withColumn(
        LABEL_COL, rule_label(F.col("f_total_events_7d"), F.col("f_avg_session_sec_7d"), rule)
    ).withColumn(TIME_COL, instant_lit(as_of_us))


def label_distribution(features: DataFrame) -> DataFrame:
    return features.groupBy(LABEL_COL).agg(F.count("*").alias("n")).orderBy(LABEL_COL)


def batch_quality(features: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row; the level is a warning and never stops a batch."""
    per_label = features.groupBy(LABEL_COL).agg(F.count("*").alias("n"))
    totals = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_labels"),
        F.array_sort(F.collect_list(LABEL_COL)).alias("labels"),
    )
    level = (
        F.when(F.col("n_rows") < 2, "too_few_rows")
        .when(F.col("n_labels") < limits.min_classes, "no_label_diversity")
        .when(F.col("n_rows") < limits.min_rows, "weak")
        .otherwise("ok")
    )
    return totals.withColumn("level", level)


def contract_columns(names: Sequence[str]) -> list[str]:
    """Contract order; the time column is always there, the label goes before the last column."""
    order = list(names)
    if TIME_COL not in order:
        order.append(TIME_COL)
    if LABEL_COL not in order:
        order.insert(len(order) - 1, LABEL_COL)
    return order


def align_to_contract(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Contract columns in contract order; columns the job does not compute are null."""
    have = set(features.columns)
    return features.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in contract_columns(names)]
    )
