"""Sliding multi-day user features on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.features import feature_columns, rule_label, session_sum, session_totals
from ..params import LABEL_COL, TIME_COL, LabelRule


def stream_features(
    events: DataFrame,
    window_days: int = 7,
    watermark: str = "1 hour",
    rule: LabelRule = LabelRule(),
) -> DataFrame:
    """One row per (user, window) once the window is closed; append mode.

    Events are first reduced to (user, day) and only those rows are copied to the overlapping
    windows, so state holds days, not events. ``event_timestamp`` is the window end.
    """
    daily = (
        events.withWatermark("event_time", watermark)
        .groupBy("user_id", F.window("event_time", "1 day").alias("day"))
        .agg(
            F.count("*").alias("_n"),
            *session_totals(),
            F.max("event_time").alias("_last"),
        )
        # a day whose decimals overflow is held by none
        .withColumn("_held", F.when(F.col("_exact").isNotNull(), F.col("_held")).otherwise(0))
    )
    sliding = daily.groupBy(
        "user_id", F.window(F.window_time("day"), f"{window_days} days", "1 day").alias("w")
    ).agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.sum("_cnt").alias("_cnt"), F.max("_last").alias("_last"),
        F.sum("_held").alias("_held"), F.try_sum("_exact").alias("_exact"),
    )
    features = sliding.select(
        "user_id",
        *feature_columns(F.col("_n"), session_sum(), F.col("_cnt"), F.col("_last"), F.unix_micros("w.end")),
        F.col("w.end").alias(TIME_COL),
    )
    return features.withColumn(
        LABEL_COL, rule_label(F.col("f_total_events_7d"), F.col("f_avg_session_sec_7d"), rule)
    )
