"""Scores of (label, prediction) pairs from one confusion count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows, accuracy, macro F1 (plain mean over labels seen in truth or prediction).

    The scored rows are read once and reduced to one row per (truth, prediction) pair.
    """
    pairs = scored.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("t") == F.col("p")
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("cls"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("seen")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("seen")),
            )
        )
    )
    # seen = (tp + fn) + (tp + fp), so F1 = 2 tp / seen
    per_class = sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("seen").alias("seen"))
    rows = F.sum("seen") / 2
    return per_class.agg(
        rows.cast("bigint").alias("n_rows"),
        (F.sum("tp") / F.nullif(rows, F.lit(0.0))).alias("accuracy"),
        F.avg(2 * F.col("tp") / F.col("seen")).alias("f1_macro"),
    )
