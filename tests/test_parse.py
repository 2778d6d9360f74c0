import math

import pytest
from pyspark.sql import functions as F

from featureops.functions.compare import above, at_least, at_most, below
from featureops.functions.parse import first_non_empty, float_or_zero, int_or_zero, wall_clock_to_instant


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}").orderBy("i")


NUMBERS = [
    # text, int, float
    ("1", 1, 1.0), ("1.9", 1, 1.9), ("-1.7", -1, -1.7), (" 2 ", 2, 2.0), ("\t7\n", 7, 7.0), ("", 0, 0.0), (None, 0, 0.0),
    ("abc", 0, 0.0), ("nan", 0, math.nan), ("-NaN", 0, math.nan), ("inf", 0, math.inf), ("-Infinity", 0, -math.inf),
    ("1.0d", 0, 0.0), ("1.0f", 0, 0.0), ("0x1p3", 0, 0.0), ("1_000", 1000, 1000.0), ("1__0", 0, 0.0), ("_1", 0, 0.0),
    (".5", 0, 0.5), ("5.", 5, 5.0), (".", 0, 0.0), ("+3", 3, 3.0), ("1e3", 1000, 1000.0), ("1e400", 0, math.inf),
    ("1,5", 0, 0.0), ("1e", 0, 0.0), ("\u00a08\u3000", 8, 8.0), ("1e19", 0, 1e19),
]


def test_numbers(spark):
    rows = column(spark, [n[0] for n in NUMBERS]).select(
        "s", int_or_zero(F.col("s")).alias("n"), float_or_zero(F.col("s")).alias("x")
    ).collect()
    for row, (text, whole, real) in zip(rows, NUMBERS):
        assert row.s == text
        assert row.n == whole, text
        assert row.x == real or (math.isnan(row.x) and math.isnan(real)), text


TIMES = [
    ("2025-11-19T10:00:00", "2025-11-19 01:00:00"), ("2025-11-19 10:00:00", "2025-11-19 01:00:00"),
    ("2025-11-19t10:00:00", "2025-11-19 01:00:00"), ("  2025-11-19T10:00:00 ", "2025-11-19 01:00:00"),
    ("2025-1-2T3:4:5", "2025-01-01 18:04:05"), ("2025-11-19   10:00:00", "2025-11-19 01:00:00"),
    ("2025-11- 9T10:00:00", "2025-11-09 01:00:00"), ("2024-02-29 00:00:00", "2024-02-28 15:00:00"),
    ("2025-11-19T10:00:00.5", None), ("2025-02-30 00:00:00", None), ("2025-01-01 00:00:60", None), ("2025-13-01 00:00:00", None),
    ("2025-01-01 24:00:00", None), ("2025-11-19T 10:00:00", None), ("2025-11-19", None), ("25-11-19 10:00:00", None),
    ("2025-11-19T10:00:00Z", None), ("", None), ("   ", None), (None, None), ("0000-01-01 00:00:00", None),
]


def test_wall_clock(spark):
    rows = column(spark, [t[0] for t in TIMES]).select(
        "s", wall_clock_to_instant(F.col("s")).cast("string").alias("t")
    ).collect()
    assert [(r.s, r.t) for r in rows] == TIMES


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", "a", "b"), (None, "", "b"), ("  ", "a", "b"), (None, None, None)], "x string, y string, z string")
    got = [r[0] for r in df.select(first_non_empty(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == ["a", "b", "  ", None]


@pytest.mark.parametrize("fn, want", [
    (above, [False, False, True, None]), (at_least, [False, True, True, None]),
    (below, [False, False, False, None]), (at_most, [False, True, False, None]),
])
def test_nan_passes_no_limit(spark, fn, want):
    df = column(spark, [math.nan, 1.0, 2.0, None], "double")
    assert [bool(r[0]) for r in df.select(fn(F.col("s"), 1.0)).collect()] == [bool(w) for w in want]
