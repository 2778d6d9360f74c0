"""Promote-or-shadow decision over a table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.compare import at_least
from ..functions.parse import number_or_null, strip
from ..params import TrainLimits

# The reason codes, and texts that mean "drift blocks promotion" after trimming, in lower case.
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def promotion_decision(runs: DataFrame, threshold: float = TrainLimits.accuracy_threshold) -> DataFrame:
    """Adds ``decision`` and ``shadow_reason`` to runs with text columns ``accuracy``, ``drift_block``."""
    drift = F.lower(strip(F.col("drift_block").cast("string"))).isin(*TRUE_WORDS)
    text = F.col("accuracy").cast("string")
    accuracy = number_or_null(text)
    reason = (
        F.when(F.coalesce(drift, F.lit(False)), "drift_detected")
        .when(text.isNull(), "train_skipped")
        .when(accuracy.isNull(), "accuracy_invalid")
        .when(at_least(accuracy, threshold), F.lit(None))
        .otherwise("below_threshold")
    )
    return runs.withColumn("shadow_reason", reason).withColumn(
        "decision", F.when(F.col("shadow_reason").isNull(), "promote").otherwise("shadow")
    )
