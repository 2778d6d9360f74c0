"""Training-data validation, stratified split, logistic regression, run records, batch scoring."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ranking import hash_cuts, order_hash, prefix_counts
from ..params import FEATURE_COLS, LABEL_COL, RunSource, TrainLimits
from ..session import instant_lit, written
from .evaluation import classification_metrics
from .softmax import SoftmaxModel, fit_softmax

RUN_SCHEMA = (
    "run_id string, run_time timestamp, status string, reason string, env string, fs_version string, "
    "schema_hash string, feature_uri string, code_version string, C double, max_iter int, "
    "feature_cols string, train_rows bigint, train_classes string, n_features int, n_classes int, "
    "accuracy double, f1_macro double"
)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def class_summary(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """One row: rows, number of classes, smallest class, rows without a label."""
    per_class = df.groupBy(F.col(label).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    known = F.col("cls").isNotNull()
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("cls").alias("n_classes"),
        F.coalesce(F.min(F.when(known, F.col("n"))), F.lit(0)).alias("min_class_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_unlabelled"),
    )


def training_check(df: DataFrame, limits: TrainLimits = TrainLimits()) -> DataFrame:
    """One row (status, reason, n_rows, n_classes, min_class_rows); the first failing rule names the reason."""
    missing = missing_columns(df, FEATURE_COLS)
    if missing or LABEL_COL not in df.columns:
        reason = f"missing feature columns {missing}" if missing else "no label column"
        return df.agg(F.count("*").alias("n_rows")).select(
            F.lit("skip").alias("status"),
            F.lit(reason).alias("reason"),
            "n_rows",
            F.lit(None).cast("bigint").alias("n_classes"),
            F.lit(None).cast("bigint").alias("min_class_rows"),
            F.lit(None).cast("bigint").alias("n_unlabelled"),
        )
    reason = (
        F.when(F.col("n_rows") < limits.min_rows, F.format_string("rows=%d", "n_rows"))
        .when(F.col("n_unlabelled") > 0, F.format_string("error: %d rows without label", "n_unlabelled"))
        .when(F.col("n_classes") < limits.min_classes, F.format_string("classes=%d", "n_classes"))
        .when(F.col("min_class_rows") < limits.min_class_rows, F.format_string("smallest class=%d", "min_class_rows"))
    )
    status = F.when(reason.isNull(), "ok").when(reason.startswith("error"), "error").otherwise("skip")
    return class_summary(df).select(
        status.alias("status"), F.coalesce(reason, F.lit("")).alias("reason"),
        "n_rows", "n_classes", "min_class_rows", "n_unlabelled",
    )


def split_quotas(sizes: DataFrame, stratum: str, test_size: float) -> DataFrame:
    """(stratum, n, quota of test rows) from (stratum, n): in total exactly ceil(test_size x rows).

    Training rows are shared out in proportion, left-over rows by the largest remainder. One
    row per class, so the global windows are over a tiny table.
    """
    whole = Window.partitionBy(F.lit(0))
    shares = sizes.withColumn("_all", F.sum("n").over(whole))
    shares = shares.withColumn("_train", F.col("_all") - F.ceil(F.lit(test_size) * F.col("_all")))
    # n * train may exceed 2^63: exact integer arithmetic in decimals
    product = F.col("n").cast("decimal(19,0)") * F.col("_train").cast("decimal(19,0)")
    rows = F.col("_all").cast("decimal(19,0)")
    shares = shares.withColumn("_rest", (product % rows).cast("bigint"))
    shares = shares.withColumn("_base", ((product - F.col("_rest")) / rows).cast("bigint"))
    order = whole.orderBy(F.desc("_rest"), stratum)
    extra = F.row_number().over(order) <= F.col("_train") - F.sum("_base").over(whole)
    train = F.col("_base") + F.when(extra, 1).otherwise(0)
    return shares.select(stratum, "n", (F.col("n") - train).alias("quota"))


def split(
    df: DataFrame,
    key_cols: Sequence[str],
    label: str = LABEL_COL,
    limits: TrainLimits = TrainLimits(),
    stratify: bool = True,
) -> DataFrame:
    """Input rows with ``is_test``. ``key_cols`` identify a row.

    Each class gets one cut in the hash order. The rows are scanned three times: for the counts by class and hash
    prefix, which are stored, for the rows next to the cuts, and for the result, to which the table of cuts (one row
    per class) is joined; AQE broadcasts it where it is small. Without ``stratify`` all rows are one class.
    """
    stratum = label if stratify else "_stratum"
    rows = df if stratify else df.withColumn("_stratum", F.lit(0))
    counts = written(prefix_counts(rows, stratum, key_cols, limits.seed), "split-counts")
    sizes = counts.groupBy(stratum).agg(F.sum("_cnt").alias("n"))
    cuts = hash_cuts(rows, counts, split_quotas(sizes, stratum, limits.test_size), stratum, key_cols, limits.seed)
    cuts = cuts.select(F.col(stratum).alias("_of"), "_cut")
    is_test = F.coalesce(order_hash(key_cols, limits.seed) <= F.col("_cut"), F.lit(False))
    joined = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("is_test", is_test).select(*df.columns, "is_test")


def can_stratify(n_rows: int, n_classes: int, min_class_rows: int, test_size: float) -> bool:
    """Each side needs room for every class, and a class at least two rows."""
    n_test = math.ceil(test_size * n_rows)
    return min_class_rows >= 2 and n_test >= n_classes and n_rows - n_test >= n_classes


def fit_classifier(train: DataFrame, classes: Sequence[int], limits: TrainLimits = TrainLimits()) -> SoftmaxModel:
    """L2 logistic regression on raw features; C is the inverse strength per data set, not per row."""
    return fit_softmax(train, FEATURE_COLS, LABEL_COL, classes, limits.C, limits.max_iter)


def score(model: SoftmaxModel, features: DataFrame) -> DataFrame:
    """Input rows with ``prediction`` (a label) and ``probability`` (one entry per class, label order)."""
    return model.score(features)


def smoke_check(model: SoftmaxModel, spark: SparkSession) -> None:
    """A row of zeros must score to one class."""
    zeros = spark.range(1).select(*[F.lit(0.0).alias(c) for c in FEATURE_COLS])
    if score(model, zeros).first().prediction is None:
        raise RuntimeError("smoke row has no prediction")


@dataclass
class TrainResult:
    run: DataFrame
    accuracy: float | None
    run_id: str | None
    model: SoftmaxModel | None
    scored_test: DataFrame | None


def _run_row(spark: SparkSession, run_time, source: RunSource, limits: TrainLimits, **values) -> DataFrame:
    known = dict(
        env=source.env, fs_version=source.fs_version, schema_hash=source.schema_hash, feature_uri=source.feature_uri,
        code_version=source.code_version, C=float(limits.C), max_iter=limits.max_iter, feature_cols=",".join(FEATURE_COLS),
        n_features=len(FEATURE_COLS), **values,
    )
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    schema = RUN_SCHEMA.replace("run_time timestamp, ", "")
    row = spark.createDataFrame([tuple(known.get(c) for c in names if c != "run_time")], schema)
    return row.withColumn("run_time", instant_lit(run_time)).select(*names)


def train(
    features: DataFrame,
    key_cols: Sequence[str],
    source: RunSource,
    run_time: datetime | str | int,
    limits: TrainLimits = TrainLimits(),
    skip_reason: str | None = None,
) -> TrainResult:
    """Validate, split, fit, score. Unusable data gives a ``skip`` run instead of a failure."""
    spark = features.sparkSession
    if skip_reason is None:
        check = training_check(features, limits).first()
        if check.status == "error":
            raise ValueError(check.reason)
        skip_reason = check.reason if check.status == "skip" else None
    if skip_reason is not None:
        run = _run_row(spark, run_time, source, limits, status="skip", reason=skip_reason)
        return TrainResult(run, None, None, None, None)
    stratify = can_stratify(check.n_rows, check.n_classes, check.min_class_rows, limits.test_size)
    typed = features.withColumn(LABEL_COL, F.col(LABEL_COL).cast("int"))
    # Written once and read back: fitting scans it many times, and lost executors must not redo the split.
    parts = written(split(typed, key_cols, limits=limits, stratify=stratify), "split")
    train_part, test_part = parts.where(~F.col("is_test")), parts.where("is_test")
    # the classes the model has seen: a plain split may leave one to the test part
    seen = parts.groupBy(LABEL_COL).agg(F.count_if(~F.col("is_test")).alias("n")).orderBy(LABEL_COL).collect()
    model = fit_classifier(train_part, [r[0] for r in seen if r.n], limits)
    smoke_check(model, spark)
    scored = score(model, test_part)
    metrics = classification_metrics(scored).first()
    run_id = uuid.uuid4().hex
    run = _run_row(
        spark, run_time, source, limits, status="ok", reason="", run_id=run_id, train_rows=check.n_rows,
        train_classes=",".join(str(r[0]) for r in seen), n_classes=check.n_classes,
        accuracy=metrics.accuracy, f1_macro=metrics.f1_macro,
    )
    return TrainResult(run, metrics.accuracy, run_id, model, scored)


def save_model(spark: SparkSession, model: SoftmaxModel, path: str) -> None:
    model.save(spark, path)


def load_model(spark: SparkSession, path: str) -> SoftmaxModel:
    return SoftmaxModel.load(spark, path)
