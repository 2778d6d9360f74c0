import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureops.functions.ranking import exact_sample
from featureops.operators.drift import (
    common_columns, drift_decision, drift_gate, drift_profile, ks_by_column, ks_from_profile, ks_full, ks_p_value, numeric_columns,
    profiled_columns, top_columns,
)
from featureops.params import DriftLimits


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v if v is None else float(v),) for v in values], f"x {kind}")


def numpy_ks(x, y):
    x, y = np.sort(x), np.sort(y)
    pooled = np.concatenate([x, y])
    return np.max(np.abs(np.searchsorted(x, pooled, "right") / x.size - np.searchsorted(y, pooled, "right") / y.size))


def normal(mean, n, seed=42):
    return np.random.default_rng(seed).normal(mean, 1, n).tolist()


def test_extreme_and_hot_values(spark):
    top = 1.7976931348623157e308
    for x, y in (([top] * 60 + [1.0], [top] * 30 + [2.0] * 31), ([-top] * 50 + [math.inf] * 9, [top] * 50 + [-math.inf] * 9), ([7.0] * 400 + normal(0, 50), [7.0] * 10 + normal(1, 300))):
        a, b = frame(spark, x), frame(spark, y)
        for extra in ({}, {"buckets": 4, "bucket_rows": 5}):
            assert ks_full(a, b, ["x"], 1, **extra).first().ks == pytest.approx(ks_by_column(a, b, ["x"], 1).first().ks)


def test_every_column_is_compared(spark):
    base = spark.range(200).select(*[(F.col("id") % 50).cast("double").alias(f"c{i}") for i in range(26)])
    moved = base.withColumn("c24", F.col("c24") + 40)
    row = drift_gate(moved, base, ["c0"], spark).first()
    assert row.block_promotion and row.worst_col == "c24" and len(row.signals) == 26


PLANS = {
    "one_level": lambda a, b, c=("x",), m=1: ks_by_column(a, b, c, m),
    "buckets": lambda a, b, c=("x",), m=1: ks_full(a, b, c, m, buckets=8, bucket_rows=30),
}


@pytest.fixture(params=list(PLANS))
def ks(request):
    return PLANS[request.param]


@pytest.mark.parametrize("new, ref, want", [
    ([1.0, 2, 3, 4, 5], [1.0, 2, 3, 4, 5], 0.0), ([1.0, 2, 3], [10.0, 11, 12], 1.0), ([1.0], [2.0], 1.0),
    ([1.0, 1, 1, 2], [1.0, 2, 2, 2], 0.5), ([0.0, 1], [-0.0, 1], 0.0), ([-math.inf, 0, math.inf], [0.0, 0, 0], 1 / 3),
])
def test_known_distances(spark, ks, new, ref, want):
    row = ks(frame(spark, new), frame(spark, ref)).first()
    assert row.ks == pytest.approx(want)
    assert row.p_value == 1.0 or want > 0


def test_against_numpy_and_symmetry(spark, ks):
    x, y = normal(0, 700), normal(0.4, 500, 7) + [0.1] * 400  # a heavy tie
    row, back = ks(frame(spark, x), frame(spark, y)).first(), ks(frame(spark, y), frame(spark, x)).first()
    assert row.ks == pytest.approx(numpy_ks(np.array(x), np.array(y)), abs=1e-15)
    assert row.ks == pytest.approx(back.ks) and (row.n_new, row.n_ref) == (700, 900)


def test_same_and_shifted_law(spark, ks):
    same = ks(frame(spark, normal(0, 200)), frame(spark, normal(0, 200, 1))).first()
    assert same.ks < 0.2 and same.p_value > 0.05
    moved = ks(frame(spark, normal(0, 500)), frame(spark, normal(2, 500, 1))).first()
    assert moved.ks > 0.5 and moved.p_value < 0.001


def test_empty_side_and_small_columns(spark, ks):
    assert ks(frame(spark, [1.0, 2.0]), frame(spark, [])).count() == 0
    assert ks(frame(spark, [1.0] * 49), frame(spark, [1.0] * 50), ("x",), 50).count() == 0
    assert ks(frame(spark, [1.0] * 50), frame(spark, [1.0] * 50), ("x",), 50).first().ks == 0.0
    assert ks(frame(spark, [1.0] * 50 + [None, math.nan]), frame(spark, [1.0] * 50), ("x",), 50).first().n_new == 50
    assert ks(frame(spark, [1.0]), frame(spark, [1.0]), ()).count() == 0


def test_nulls_stay_in_their_column(spark, ks):
    a = spark.createDataFrame([(None, i, i % 2 == 0) for i in range(60)], "n double, i int, b boolean")
    b = spark.createDataFrame([(1.0, i + 30, True) for i in range(60)], "n double, i int, b boolean")
    got = {r.col_name: (r.col_pos, r.n_new, round(r.ks, 6)) for r in ks(a, b, ("n", "i", "b"), 50).collect()}
    assert got == {"i": (1, 60, 0.5), "b": (2, 60, 0.5)}


def test_p_value(spark):
    df = spark.createDataFrame([(0.0, 100, 100), (0.5, 0, 100), (0.99, 1000, 1000), (0.1, 100, 100)], "d double, n long, m long")
    p = [r[0] for r in df.select(ks_p_value(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert p[:2] == [1.0, 1.0] and 0.0 <= p[2] <= 1.0 and p[3] == pytest.approx(2 * math.exp(-2 * 0.01 * 50))


def test_numeric_columns(spark):
    df = spark.createDataFrame([], "num1 double, str_col string, num2 long, bool_col boolean, t timestamp, d decimal(9,2)")
    assert numeric_columns(df.schema, 10) == ["num1", "num2", "bool_col", "d"]
    many = spark.createDataFrame([], ", ".join(f"col_{i} double" for i in range(10)))
    assert numeric_columns(many.schema, 3) == ["col_0", "col_1", "col_2"]
    # the cut comes before the intersection
    assert common_columns(many, many.select("col_2", "col_5"), 3) == ["col_2"]
    assert numeric_columns(df.select("str_col").schema, 5) == []


def table(spark, rows):
    return spark.createDataFrame(rows, "col_pos int, col_name string, n_new long, n_ref long, ks double, p_value double")


def test_decision(spark):
    tie = drift_decision(table(spark, [(1, "b", 9, 9, 0.3, 0.01), (0, "a", 9, 9, 0.3, 0.5), (2, "c", 9, 9, 0.1, 0.9)])).first()
    assert (tie.block_promotion, tie.worst_col) == (True, "a")
    assert tie.reason == "DRIFT_BLOCK: worst_col=a ks=0.3000 p=5.00e-01 (> 0.2)"
    assert tie.signals == {"a": 0.3, "b": 0.3, "c": 0.1}
    assert not drift_decision(table(spark, [(0, "a", 9, 9, 0.2, 0.5)])).first().block_promotion  # strict
    none = drift_decision(table(spark, [])).first()
    assert none.reason == "DRIFT_OK: worst_col=- ks=0.0000 p=1.00e+00 (<= 0.2)"
    zero = drift_decision(table(spark, [(0, "a", 9, 9, 0.0, 1.0)])).first()
    assert zero.worst_col == "-"
    rows = [(i, f"c{i}", 9, 9, [0.1, 0.4, 0.4, 0.0, 0.2, 0.3][i], 1.0) for i in range(6)]
    assert [r.col_name for r in top_columns(table(spark, rows)).collect()] == ["c1", "c2", "c5", "c4", "c0"]


def features(spark, scale=1.0, n=300):
    rows = spark.range(n).select(F.col("id").alias("user_id"), (F.rand(3) * 100 * scale).alias("f"))
    return rows


@pytest.mark.parametrize("whole", [False, True])
def test_gate(spark, whole):
    limits = DriftLimits(sample_n=None if whole else 200)
    blocked = drift_gate(features(spark, 3.0), features(spark), ["user_id"], spark, limits, ("user_id",)).first()
    assert blocked.block_promotion and blocked.worst_col == "f"
    fine = drift_gate(features(spark), features(spark), ["user_id"], spark, limits, ()).first()
    assert not fine.block_promotion and fine.reason.startswith("DRIFT_OK")


def test_gate_skips(spark):
    only_text = spark.createDataFrame([("a",)], "s string")
    assert drift_gate(features(spark), only_text, ["user_id"], spark).first().reason == "DRIFT_SKIPPED: no common numeric columns"
    first = drift_gate(features(spark), None, ["user_id"], spark).first()
    assert (first.block_promotion, first.reason) == (False, "DRIFT_SKIPPED: missing feature_uri or latest_prefix")


def test_exact_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    picked = {r.k for r in exact_sample(df, 700, ["k"], 42).collect()}
    assert len(picked) == 700
    again = {r.k for r in exact_sample(df.repartition(7), 700, ["k"], 42).collect()}
    assert picked == again
    assert picked != {r.k for r in exact_sample(df, 700, ["k"], 43).collect()}
    assert exact_sample(df, 5000, ["k"], 42).count() == 5000 and exact_sample(df, 9999, ["k"], 42).count() == 5000
    assert exact_sample(df.limit(0), 5, ["k"], 42).count() == 0


def test_profile_gives_the_same_distances(spark, tmp_path):
    """Against the stored profile: equal results, reference rows only from open buckets, none where the profile settles it."""
    rnd = random.Random(4)
    rows = [(i, rnd.gauss(0, 1), float(rnd.randrange(4)), None if i % 9 == 0 else rnd.expovariate(1), math.nan if i % 11 == 0 else 1.0) for i in range(4_000)]
    names = "k long, a double, ties double, holes double, flat double"
    ref, new = spark.createDataFrame(rows, names), spark.createDataFrame([(k + 500, a * 1.2, t, h, f) for k, a, t, h, f in rows[:3_000]], names)
    columns = ["k", "a", "ties", "holes", "flat"]
    want = sorted(map(tuple, ks_by_column(new, ref, columns).collect()))
    for buckets in (4, 64, 1024):
        profile = drift_profile(ref, buckets)
        assert profile.groupBy("col_name").sum("n").where("col_name = 'a'").first()[1] == 4_000
        assert profiled_columns(new, profile) == columns
        got = sorted(map(tuple, ks_from_profile(new, profile, ref, columns).collect()))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert all(g[4:] == pytest.approx(w[4:], abs=1e-12) for g, w in zip(got, want))
    # integers of few values: every bucket holds one value, so no reference row is needed
    few = ref.select((F.col("k") % 20).alias("k"))
    settled = ks_from_profile(few.where("k < 15"), drift_profile(few), spark.createDataFrame([], "k long"), ["k"])
    assert settled.first().ks == pytest.approx(ks_by_column(few.where("k < 15"), few, ["k"]).first().ks)
    # too coarse: the full plan takes over
    assert ks_from_profile(new, drift_profile(ref, 4), ref, ["a"], bucket_rows=10).first().ks == pytest.approx(want[1][4])
    assert ks_from_profile(new.limit(3), drift_profile(ref), ref, columns).count() == 0
