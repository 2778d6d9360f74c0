from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureops.functions.ranking import order_hash
from featureops.operators.evaluation import classification_metrics
from featureops.operators.promotion import promotion_decision
from featureops.operators.softmax import fit_softmax
from featureops.operators.training import can_stratify, load_model, save_model, score, smoke_check, split, train, training_check
from featureops.params import FEATURE_COLS, RunSource

AT = "2025-11-20T00:00:00"


def frame(spark, labels):
    rows = [(i, float(i), float(i), float(i), v) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{c} double" for c in FEATURE_COLS) + ", label int")


@pytest.mark.parametrize("labels, status, reason", [
    ([i % 2 for i in range(100)], "ok", ""), ([i % 2 for i in range(20)], "ok", ""), ([i % 3 for i in range(90)], "ok", ""),
    ([i % 2 for i in range(10)], "skip", "rows=10"), ([0] * 50, "skip", "classes=1"), ([0] * 48 + [1] * 2, "skip", "smallest class=2"),
    ([0, None] * 20, "error", "error: 20 rows without label"), ([], "skip", "rows=0"),
])
def test_training_check(spark, labels, status, reason):
    row = training_check(frame(spark, labels)).first()
    assert (row.status, row.reason, row.n_rows) == (status, reason, len(labels))


def test_training_check_columns(spark):
    good = frame(spark, [0, 1] * 20)
    row = training_check(good.drop("label")).first()
    assert (row.status, row.reason) == ("skip", "no label column")
    row = training_check(good.select("label", F.lit(1).alias("wrong_col"))).first()
    assert row.status == "skip" and all(c in row.reason for c in FEATURE_COLS)


def test_stratified_split(spark):
    labels = [0] * 331 + [1] * 97 + [2] * 29
    rows = split(frame(spark, labels), ["user_id"]).collect()
    assert len(rows) == len(labels) and rows[0].asDict().keys() >= {"user_id", "is_test", "label"}
    tests = Counter(r.label for r in rows if r.is_test)
    assert sum(tests.values()) == 92  # ceil(0.2 * 457)
    assert all(abs(tests[c] - 0.2 * labels.count(c)) < 1 for c in (0, 1, 2))
    again = split(frame(spark, labels).repartition(5), ["user_id"]).collect()
    assert {r.user_id for r in rows if r.is_test} == {r.user_id for r in again if r.is_test}


def test_plain_split(spark):
    rows = split(frame(spark, [0, 1] * 51), ["user_id"], stratify=False).collect()
    assert len(rows) == 102 and sum(r.is_test for r in rows) == 21


def test_split_with_null_and_composite_keys(spark, tmp_path, capsys):
    """Keys that look alike when joined, nulls in keys and labels: sizes are exact, and the rows are scanned three times."""
    rows = [(a, b, i % 3 if i % 7 else None) for i, (a, b) in enumerate((x, y) for x in ("", None, "a", "a|", "|") for y in ("", None, "|b", "b", "a|b", "1:a"))]
    rows += [(f"k{i}", None, i % 3) for i in range(400)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "a string, b string, label int").write.parquet(path)
    df = spark.read.parquet(path)
    assert df.select(order_hash(["a", "b"], 42)).distinct().count() == len(rows)
    parts = split(df, ["a", "b"])
    parts.explain()
    assert capsys.readouterr().out.count("/rows]") == 2  # and one scan for the counts, which are stored
    got = Counter((r.label, r.is_test) for r in parts.collect())
    assert sum(n for (_, t), n in got.items() if t) == 86  # ceil(0.2 * 430)
    assert all(abs(got[c, True] - 0.2 * (got[c, True] + got[c, False])) < 1 for c in (0, 1, 2, None))


def test_can_stratify():
    assert can_stratify(20, 2, 3, 0.2) and not can_stratify(20, 6, 3, 0.2) and not can_stratify(20, 2, 1, 0.2)


def test_metrics(spark):
    truth = [0, 0, 0, 1, 1, 2]
    guess = [0, 0, 1, 1, 3, 0]
    df = spark.createDataFrame(list(zip(truth, guess)), "label int, prediction int")
    row = classification_metrics(df).first()
    f1 = [2 * 2 / (3 + 3), 2 * 1 / (2 + 2), 0.0, 0.0]
    assert (row.n_rows, row.accuracy) == (6, 0.5)
    assert row.f1_macro == pytest.approx(sum(f1) / 4)
    empty = classification_metrics(df.limit(0)).first()
    assert empty.accuracy is None and empty.f1_macro is None


def test_train_score_save(spark, tmp_path):
    df = frame(spark, [0] * 60 + [2] * 60 + [5] * 60)  # labels need not be 0, 1, 2
    result = train(df, ["user_id"], RunSource("uri", "v_1", "hash", "dev", "abc"), AT)
    run = result.run.first()
    assert run.status == "ok" and run.accuracy == result.accuracy > 0.8 and run.run_id == result.run_id
    assert (run.train_rows, run.train_classes, run.n_features, run.n_classes) == (180, "0,2,5", 3, 3)
    assert (run.fs_version, run.schema_hash, run.env, run.code_version, run.C, run.max_iter) == ("v_1", "hash", "dev", "abc", 1.0, 200)
    assert result.scored_test.count() == 36
    save_model(spark, result.model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    assert loaded == result.model
    smoke_check(loaded, spark)
    rows = score(loaded, df).collect()
    assert {r.prediction for r in rows} <= {0, 2, 5} and all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)


def plain_newton(x, y, k, c):
    """Dense restatement: gradient and Hessian of all rows at once, one class vector each, damped."""
    n, d = x.shape
    one = np.hstack([np.ones((n, 1)), x])
    target = np.eye(k)[y]
    ridge = np.tile(np.r_[0.0, np.full(d, 1 / (c * n))], k)

    def at(b):
        z = one @ b.reshape(k, d + 1).T
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return p, -np.log((p * target).sum(1)).mean() + 0.5 * ridge @ b**2

    b = np.zeros(k * (d + 1))
    for _ in range(100):
        p, value = at(b)
        gradient = ((p - target).T @ one).ravel() / n + ridge * b
        hessian = np.block([[(one * (p[:, [i]] * ((i == j) - p[:, [j]]))).T @ one for j in range(k)] for i in range(k)]) / n + np.diag(ridge)
        step, t = -np.linalg.lstsq(hessian, gradient, rcond=1e-15)[0], 1.0
        while at(b + t * step)[1] > value and t > 1e-8:
            t /= 2
        b = b + t * step
    return at(b)[0]


@pytest.mark.parametrize("k, C", [(3, 1.0), (3, 0.01), (4, 100.0)])
def test_newton_reaches_the_dense_optimum(spark, k, C):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 2)) * [1.0, 5.0] + [0.0, 3.0]
    y = np.array([(int(a > 0) + int(b > 3) + int(rng.random() < 0.3)) % k for a, b in x])
    df = spark.createDataFrame([(float(a), float(b), int(v)) for (a, b), v in zip(x, y)], "a double, b double, v int").repartition(3)
    model = fit_softmax(df, ["a", "b"], "v", range(k), C)
    assert model.gradient <= 1e-9 and model.steps < 40 and list(model.losses) == sorted(model.losses, reverse=True)
    got = {(r.a, r.b): r.probability for r in model.score(df).collect()}
    want = plain_newton(x, y, k, C)
    assert all(got[tuple(map(float, r))] == pytest.approx(list(p), abs=1e-6) for r, p in zip(x, want))


@pytest.mark.parametrize("k", [2, 3, 4])
def test_newton_where_the_penalty_is_below_rounding(spark, k):
    """Many rows or wide features make the penalty too small to tell classes' common moves, or equal features, apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)).round(3)
    y = np.array([int(rng.integers(k)) if rng.random() < 0.3 else int(sum(a > c for c in (0, 0.5, 1)[: k - 1])) for a, b in x])
    rows = [(float(a) * 1e9, float(b) * 1e9, int(v)) for (a, b), v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, v int").withColumns({"again": F.col("a"), "twice": 2 * F.col("a")}).repartition(3)
    want = plain_newton(x, y, k, 1e18)
    for features in (["a", "b"], ["a", "again", "b", "twice"]):
        model = fit_softmax(df, features, "v", range(k))
        assert model.gradient <= 1e-9 and model.steps < 40 and list(model.losses) == sorted(model.losses, reverse=True)
        assert k == 2 or np.abs(np.sum(model.weights, axis=0)).max() < 1e-9 * np.abs(model.weights).max()
        got = {(r.a, r.b): r.probability for r in model.score(df).collect()}
        assert all(got[r[:2]] == pytest.approx(list(p), abs=1e-6) for r, p in zip(rows, want))


def test_newton_on_separable_and_bad_rows(spark):
    rows = spark.createDataFrame([(float(i), int(i > 50)) for i in range(100)], "a double, v int")
    model = fit_softmax(rows, ["a"], "v", [0, 1])
    assert model.gradient <= 1e-9 and model.weights[0] == (0.0,) and model.score(rows).where("prediction <> v").count() == 0
    for bad in ("NULL", "DOUBLE('NaN')"):
        with pytest.raises(ValueError):
            fit_softmax(rows.union(spark.sql(f"SELECT {bad}, 1")), ["a"], "v", [0, 1])
    with pytest.raises(ValueError):
        fit_softmax(rows.union(spark.sql("SELECT 1.0D, NULL")), ["a"], "v", [0, 1])


def test_train_two_classes(spark):
    result = train(frame(spark, [1] * 40 + [4] * 40), ["user_id"], RunSource("uri"), AT)
    assert result.accuracy > 0.8 and {r.prediction for r in result.scored_test.collect()} <= {1, 4}


def test_train_skips_and_fails(spark):
    skipped = train(frame(spark, [0] * 30), ["user_id"], RunSource("uri"), AT)
    assert skipped.accuracy is None and skipped.run.first().status == "skip" and skipped.run.first().reason == "classes=1"
    with pytest.raises(ValueError):
        train(frame(spark, [0, None] * 20), ["user_id"], RunSource("uri"), AT)


@pytest.mark.parametrize("accuracy, flag, reason", [
    ("0.60", None, None), ("0.59", None, "below_threshold"), (None, None, "train_skipped"), ("abc", None, "accuracy_invalid"),
    ("", None, "accuracy_invalid"), ("NaN", None, "below_threshold"), ("inf", "False", None), ("0.9", " TRUE ", "drift_detected"),
    (None, "1", "drift_detected"), ("0.9", "on", "drift_detected"), ("0.9", "y", "drift_detected"), ("0.9", "0", None),
])
def test_promotion(spark, accuracy, flag, reason):
    row = promotion_decision(spark.createDataFrame([("r", accuracy, flag)], "run_id string, accuracy string, drift_block string")).first()
    assert (row.shadow_reason, row.decision) == (reason, "promote" if reason is None else "shadow")
