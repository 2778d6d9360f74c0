"""Metric samples: (metric, job, namespace, labels map, ts, value), one row per scrape of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..params import EvalGrid

SAMPLE_SCHEMA = (
    "metric string, job string, namespace string, labels map<string,string>, ts timestamp, value double"
)
# A map cannot be a window key, so a series is identified by its labels in sorted order.
SERIES = ("job", "namespace", "series")


def series_key() -> Column:
    return F.array_sort(F.map_entries("labels")).alias("series")


def series_labels() -> Column:
    return F.map_from_entries("series").alias("labels")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).parquet(path)


def label_matches(label: str, pattern: str) -> Column:
    """Anchored regular expression on a label; an absent label is an empty text."""
    return F.coalesce(F.col("labels")[label], F.lit("")).rlike(f"^(?:{pattern})$")


def select_metric(samples: DataFrame, metric: str, job: str | None = None, namespace: str | None = None) -> DataFrame:
    picked = samples.where(F.col("metric") == metric)
    if job is not None:
        picked = picked.where(F.col("job") == job)
    if namespace is not None:
        picked = picked.where(F.col("namespace") == namespace)
    return picked


def within(samples: DataFrame, grid: EvalGrid, window_us: int) -> DataFrame:
    """Samples any evaluation of the grid can see: (first evaluation - window, last evaluation]."""
    last_eval = grid.start_us + grid.last * grid.step_us
    return samples.where(
        (F.col("ts") > F.timestamp_micros(F.lit(grid.start_us - window_us)))
        & (F.col("ts") <= F.timestamp_micros(F.lit(last_eval)))
    )
