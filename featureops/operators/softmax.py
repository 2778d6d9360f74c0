"""Multinomial logistic regression with an L2 penalty, by Newton steps over distributed sums.

Minimises  mean log loss + |weights|^2 / (2 C n)  over one weight vector and one free intercept per class (of two
classes only the second has them). Each step is one aggregation: value, gradient and Hessian are sums over the rows,
of as many numbers as (classes x (features + 1)) squared; the driver solves that small system. Features are centred
and scaled for the sums only. A step that raises the value is halved, so that the search ends on separable
data too. Sums are the same for any partitioning up to rounding, and the optimum is unique: another engine that
follows the same steps gets the same probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MODEL_SCHEMA = "label int, intercept double, weights array<double>, features array<string>, steps int, gradient double"


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Probabilities of scores, without overflow."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    grown = [F.exp(s - top) for s in scores]
    total = sum(grown[1:], grown[0])
    return [g / total for g in grown]


@dataclass(frozen=True)
class SoftmaxModel:
    features: tuple[str, ...]
    labels: tuple[int, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    steps: int = 0
    gradient: float = 0.0  # largest entry at the end, of scaled features
    losses: tuple[float, ...] = field(default=(), compare=False)

    def probabilities(self) -> list[Column]:
        return softmax([
            sum((F.col(c).cast("double") * w for c, w in zip(self.features, ws)), F.lit(b)) for b, ws in zip(self.intercepts, self.weights)
        ])

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``prediction`` (a label, the smallest of equally likely ones) and ``probability`` (by label order)."""
        by_label = [F.struct(p.alias("p"), F.lit(-k).alias("k")) for k, p in zip(self.labels, self.probabilities())]
        scored = rows.withColumn("probability", F.array(*self.probabilities()))
        return scored.select(*rows.columns, (-F.greatest(*by_label)["k"]).alias("prediction"), "probability")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (k, b, list(w), list(self.features), self.steps, self.gradient) for k, b, w in zip(self.labels, self.intercepts, self.weights)
        ]
        spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxModel:
        rows = spark.read.parquet(path).orderBy("label").collect()
        return cls(
            tuple(rows[0].features), tuple(r.label for r in rows), tuple(r.intercept for r in rows), tuple(tuple(r.weights) for r in rows),
            rows[0].steps, rows[0].gradient,
        )


def scales(rows: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature (1 for a constant one)."""
    one = rows.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = np.array(one[0::2], float), np.array(one[1::2], float)
    return mean, np.where(spread > 0, spread, 1.0)


def derivatives(
    rows: DataFrame, labels: Sequence[int], mean: np.ndarray, spread: np.ndarray, beta: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the rows (features, then the label) of the log loss, its gradient and its Hessian at ``beta`` (classes x inputs).

    Each task multiplies its batches as matrices and gives out one row of sums; these are added up by position."""
    free, inputs = beta.shape
    known = np.array(labels)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, hessian = 0.0, np.zeros((free, inputs)), np.zeros((free, inputs, free, inputs))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack([np.ones(batch.num_rows), (np.column_stack(columns[:-1]) - mean) / spread])
            y = (columns[-1][:, None] == known).astype(float)
            z = x @ beta.T
            if free < len(known):  # of two classes the first one's score is zero
                z = np.column_stack([np.zeros(len(z)), z])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= float((y * np.log(np.maximum(p, 1e-300))).sum())
            p, y = p[:, -free:], y[:, -free:]
            gradient += (p - y).T @ x
            for k in range(free):
                for m in range(free):
                    hessian[k, :, m, :] += (x * (p[:, k] * ((k == m) - p[:, m]))[:, None]).T @ x
        yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([[loss], gradient.ravel(), hessian.ravel()])]})

    found = rows.mapInArrow(sums, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
    total = np.zeros(1 + free * inputs + (free * inputs) ** 2)
    for r in found:
        total[r.pos] = r.total
    size = free * inputs
    return float(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)


def fit_softmax(
    rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[int], C: float = 1.0,
    max_iter: int = 200, tolerance: float = 1e-12,
) -> SoftmaxModel:
    """Fit on all rows; they are scanned once a step, so give a stored table. Ends when no entry of the mean gradient
    is above the tolerance, or no entry of the next step above 1e-9, or after ``max_iter`` evaluations. A null or NaN is an error."""
    labels = sorted(labels)
    spotless = rows.select(*features, label)
    unusable = " OR ".join([f"`{c}` IS NULL" for c in [*features, label]] + [f"isnan(`{c}`)" for c in features])
    if not spotless.where(unusable).isEmpty():
        raise ValueError("rows with a null or NaN feature, or without a label")
    n = rows.count()
    mean, spread = scales(rows, features)
    inputs_only = rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double"))
    free, inputs = (len(labels) if len(labels) > 2 else 1), len(features) + 1
    # the penalty is on the weights of unscaled features
    ridge = np.tile(np.concatenate([[0.0], 1.0 / (C * n * spread**2)]), free)
    # An input's weights in all classes may move together without any effect on the loss. Only the penalty acts against that,
    # and it is nothing beside rounding where rows are many; the optimum has such sums at zero, so steps are taken within those.
    apart = np.linalg.svd(np.ones((1, free)))[2][1:].T if free > 1 else np.ones((1, 1))
    within = np.kron(apart, np.eye(inputs))
    base, step, share, value = np.zeros(free * inputs), np.zeros(free * inputs), 1.0, np.inf
    gradient = np.full(free * inputs, np.nan)
    losses: list[float] = []
    for steps in range(1, max_iter + 1):
        at = base + share * step
        loss, slope, hessian = derivatives(inputs_only, labels, mean, spread, at.reshape(free, inputs))
        now, slope = loss / n + 0.5 * float(ridge @ at**2), slope / n + ridge * at
        # the last steps gain less than the value is rounded by; there a smaller gradient counts
        if not (now <= value or (now <= value * (1 + 1e-13) and np.max(np.abs(slope)) < np.max(np.abs(gradient)))):
            share /= 2
            if share < 1e-10:
                break
            continue
        base, share, value, gradient = at, 1.0, min(now, value), slope
        losses.append(value)
        bend = within.T @ (hessian / n + np.diag(ridge)) @ within
        # least squares: features that depend on each other leave directions without a bend, which the step doesn't take
        step = -within @ np.linalg.lstsq(bend, within.T @ gradient)[0]
        if np.max(np.abs(gradient)) <= tolerance or np.max(np.abs(step)) <= 1e-9:
            break
    beta = base.reshape(free, inputs)
    weights = beta[:, 1:] / spread
    intercepts = beta[:, 0] - weights @ mean
    if free == 1:
        weights, intercepts = np.vstack([np.zeros_like(weights), weights]), np.concatenate([[0.0], intercepts])
    return SoftmaxModel(
        tuple(features), tuple(labels), tuple(map(float, intercepts)), tuple(tuple(map(float, w)) for w in weights),
        steps, float(np.max(np.abs(gradient))), tuple(losses),
    )
