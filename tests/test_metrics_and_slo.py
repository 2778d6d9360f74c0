import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureops.operators.rates import (
    counter_rates, dealt, error_signals, latency_quantile, min_up, newest_in_lookback, quantile_of_buckets, series_present,
)
from featureops.operators.slo import escalation, fleet_convergence, rollback_decision
from featureops.params import EvalGrid, RollbackLimits
from featureops.plans.observe_job import observe_with_escalation
from featureops.session import epoch_us
from featureops.sources.metric_samples import SAMPLE_SCHEMA, label_matches

T0 = datetime(2025, 1, 1)
MIN = 60_000_000


def samples(spark, rows):
    """rows: (metric, labels, seconds after T0, value[, namespace])"""
    full = [(r[0], "job", r[4] if len(r) > 4 else "ns", r[1], T0 + timedelta(seconds=r[2]), float(r[3])) for r in rows]
    return spark.createDataFrame(full, SAMPLE_SCHEMA)


def counter(spark, points, **labels):
    return samples(spark, [("http_requests_total", labels, s, v) for s, v in points])


def at(seconds):
    return EvalGrid.at(epoch_us("2025-01-01T00:00:00") + seconds * 1_000_000)


def rates_of(spark, points, grid, window, extrapolate):
    return {r.eval_ts: r.rate for r in counter_rates(counter(spark, points), grid, window, extrapolate).collect()}


def test_plain_rate_reset_and_edges(spark):
    # the sample at the left edge is outside, the one at the right edge inside
    points = [(0, 100), (15, 110), (30, 5), (45, 8), (60, 9), (75, 500)]
    assert list(rates_of(spark, points, at(60), MIN, False).values()) == [pytest.approx((5 + 3 + 1) / 60)]
    assert rates_of(spark, [(15, 1)], at(60), MIN, False) == {}
    assert rates_of(spark, [(0, 1), (61, 2)], at(60), MIN, False) == {}


def prometheus_rate(points, end, window):
    """Literal re-statement of the documented extrapolation, for one window (end - window, end]."""
    seen = [(t, v) for t, v in sorted(points) if end - window < t <= end]
    if len(seen) < 2:
        return None
    increase = sum(b - a if b >= a else b for (_, a), (_, b) in zip(seen, seen[1:]))
    span = seen[-1][0] - seen[0][0]
    mean = span / (len(seen) - 1)
    start, stop = seen[0][0] - (end - window), end - seen[-1][0]
    if start >= mean * 1.1:
        start = mean / 2
    if increase > 0 and seen[0][1] >= 0:
        start = min(start, span * seen[0][1] / increase)
    if stop >= mean * 1.1:
        stop = mean / 2
    return increase * (span + start + stop) / span / window


@pytest.mark.parametrize("step, window", [(15, 60), (60, 60), (40, 60), (300, 60), (7, 21)])
def test_grid_matches_brute_force(spark, step, window):
    rnd = random.Random(step * window)
    t, v, points = 0, 0, []
    for _ in range(200):
        t += rnd.choice([5, 10, 15, 15, 15, 90])
        v = rnd.randint(0, 5) if rnd.random() < 0.05 else v + rnd.randint(0, 9)
        points.append((t, v))
    end = 1500
    start_us = epoch_us("2025-01-01T00:00:00")
    grid = EvalGrid(start_us + 100_000_000, start_us + end * 1_000_000, step * 1_000_000)
    for extrapolate in (True, False):
        got = rates_of(spark, points, grid, window * 1_000_000, extrapolate)
        want = {}
        for e in range(100, end + 1, step):
            r = prometheus_rate(points, e, window)
            if r is not None and not extrapolate:
                seen = [v for t, v in points if e - window < t <= e]
                r = sum(b - a if b >= a else b for a, b in zip(seen, seen[1:])) / window
            if r is not None:
                want[T0 + timedelta(seconds=e)] = r
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_one_exchange_and_one_row_a_sample(spark, capsys):
    """Windows of five minutes every 15 seconds over scrapes every 15 seconds: 20 windows overlap, nothing is copied to them."""
    rows = counter(spark, [(15 * i, i) for i in range(2_000)], pod="a").unionByName(counter(spark, [(15 * i, 7 * i) for i in range(2_000)], pod="b"))
    start = epoch_us("2025-01-01T00:00:00")
    grid = EvalGrid(start, start + 15_000_000 * 2_000)
    sent = dealt(rows.withColumn("metric", F.lit("m")), grid, {"m": 5 * MIN}).count()
    assert sent <= 1.15 * 4_000
    rated = counter_rates(rows, grid, 5 * MIN, False)
    rated.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert rated.count() == 2 * 2_000
    assert {round(r.rate * 300) for r in rated.where("labels.pod = 'b' AND eval_ts > TIMESTAMP '2025-01-01 01:00:00' AND eval_ts < TIMESTAMP '2025-01-01 08:00:00'").collect()} == {19 * 7}


def test_series_are_kept_apart_by_all_labels(spark):
    rows = [("http_requests_total", {"status": s, "pod": p}, t, t * k) for (s, p, k) in (("200", "a", 1), ("500", "a", 2), ("200", "b", 3)) for t in (15, 30, 45, 60)]
    rows += [("http_requests_total", {"pod": "c", "status": "200"}, 15, 1), ("http_requests_total", {"status": "200", "pod": "c"}, 60, 46)]
    got = counter_rates(samples(spark, rows), at(60), MIN, False).collect()
    assert sorted((r.labels["pod"], r.labels["status"], round(r.rate * 60)) for r in got) == [
        ("a", "200", 45), ("a", "500", 90), ("b", "200", 135), ("c", "200", 45)]


def rated(spark, rows):
    return spark.createDataFrame([("job", "ns", labels, T0, rate) for labels, rate in rows],
                                 "job string, namespace string, labels map<string,string>, eval_ts timestamp, rate double")


def test_error_signals(spark):
    row = error_signals(rated(spark, [({"status": "200"}, 3.0), ({"status": "503"}, 1.0), ({"status": "5000"}, 4.0)])).first()
    assert (row.total_rps, row.rps_5xx, row.ratio_5xx) == (8.0, 1.0, 0.125)
    low = error_signals(rated(spark, [({"status": "200"}, 0.1), ({"status": "500"}, 0.1)])).first()
    assert low.ratio_5xx == 0.1  # divided by 1, not by 0.2
    none = error_signals(rated(spark, [({"status": "200"}, 3.0), ({}, 1.0)])).first()
    assert (none.rps_5xx, none.ratio_5xx) == (None, None)


def test_label_regex_is_anchored(spark):
    df = spark.createDataFrame([({"s": "500"},), ({"s": "1500"},), ({},)], "labels map<string,string>")
    assert [r[0] for r in df.select(label_matches("s", "5..")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(label_matches("s", "|500")).collect()] == [True, False, True]


INF = math.inf


@pytest.mark.parametrize("buckets, q, want", [
    ([(0.1, 10.0), (0.5, 90.0), (INF, 100.0)], 0.5, 0.1 + 0.4 * 40 / 80), ([(0.1, 10.0), (0.5, 90.0), (INF, 100.0)], 0.95, 0.5),
    ([(0.1, 100.0), (INF, 100.0)], 0.5, 0.05), ([(-1.0, 10.0), (1.0, 20.0), (INF, 20.0)], 0.2, -1.0),
    ([(0.1, 10.0), (0.5, 90.0)], 0.5, math.nan), ([(INF, 10.0)], 0.5, math.nan), ([(0.1, 0.0), (INF, 0.0)], 0.5, math.nan),
    ([(0.1, 50.0), (0.5, 40.0), (INF, 100.0)], 0.5, 0.1),  # a falling bound is lifted
])
def test_quantile(spark, buckets, q, want):
    df = spark.createDataFrame([("k", *b) for b in buckets], "k string, le double, rate double")
    got = quantile_of_buckets(df, ("k",), q).first().p95
    assert got == pytest.approx(want, nan_ok=True)


def test_latency_reads_le_text(spark):
    row = latency_quantile(rated(spark, [({"le": "0.1", "pod": "a"}, 5.0), ({"le": "0.1", "pod": "b"}, 5.0), ({"le": "+Inf"}, 10.0), ({}, 7.0)])).first()
    assert row.p95 == pytest.approx(0.095)


def test_sums_of_rates_in_any_order(spark):
    """Counts of four pods by bound over 12 hours, whose p95 lies on a limit: no order of the rows changes a digit."""
    counts = {"10": (5, 0, 1, 1), "25": (7, 4, 5, 4), "50": (9, 5, 9, 7), "100": (10, 7, 11, 8), "250": (11, 7, 12, 9), "+Inf": (11, 8, 12, 9)}
    p95, errors = set(), set()
    for order in itertools.permutations(range(4)):
        rows = [("http_request_duration_seconds_bucket", "j", "n", {"le": le, "pod": str(i)}, T0, of[i] / 43_200) for le, of in counts.items() for i in order]
        rates = spark.createDataFrame(rows, "metric string, job string, namespace string, labels map<string,string>, eval_ts timestamp, rate double").coalesce(1)
        p95.add(latency_quantile(rates).first().p95)
        failed = rates.where(F.col("labels")["le"] == "50").withColumn("labels", F.create_map(F.lit("status"), F.lit("500")))
        errors.add(error_signals(failed).first().rps_5xx)
    assert len(p95) == len(errors) == 1
    big = spark.createDataFrame([("j", "n", {"status": "500"}, T0, v) for v in (1e300, 2.5, None)], "job string, namespace string, labels map<string,string>, eval_ts timestamp, rate double")
    assert error_signals(big).first().total_rps == 1e300


def test_gauges(spark):
    rows = [("up", {"pod": "a"}, 0, 1), ("up", {"pod": "a"}, 50, 0), ("up", {"pod": "b"}, 20, 1), ("up", {"pod": "c"}, 0, 0)]
    got = {r.labels["pod"]: r.value for r in newest_in_lookback(samples(spark, rows), at(60), MIN).collect()}
    assert got == {"a": 0.0, "b": 1.0}  # c is exactly at the open edge
    assert min_up(samples(spark, rows), at(60), MIN).first().min_up == 0.0
    targets = spark.createDataFrame([("job", "ns"), ("job", "gone")], "job string, namespace string")
    present = series_present(targets, samples(spark, rows), "up", at(60), MIN).collect()
    assert {r.namespace: r.present for r in present} == {"ns": True, "gone": False}


SIGNALS = "job string, namespace string, min_up double, ratio_5xx double, rps_5xx double, p95 double"


@pytest.mark.parametrize("change, rollback, reason", [
    ({"rps": 0.05, "p95": 0.1}, False, "OK"),
    ({"up": None}, False, "OBSERVABILITY_UNAVAILABLE: up metric missing"),
    ({"up": 0.0}, True, "FASTAPI_UNHEALTHY: min(up)=0.0 < 1.0"),
    ({"ratio": 0.05, "rps": 2.0}, True, "ERROR_BUDGET_EXCEEDED: 5xx_ratio=0.050000 (> 0.02), 5xx_rps=2.000 (> 1.0)"),
    ({"ratio": 0.05}, False, "OK"),
    ({"ratio": None, "rps": None}, False, "OBSERVABILITY_PARTIAL: 5xx metrics missing"),
    ({"ratio": None, "rps": None, "p95": 9.0}, False, "OBSERVABILITY_PARTIAL: 5xx metrics missing"),
    ({"p95": 1.5}, True, "LATENCY_TOO_HIGH: p95=1.500000s (> 0.8s)"),
    ({"p95": None}, False, "OBSERVABILITY_PARTIAL: latency metric missing"),
    ({"p95": math.nan}, False, "OK"), ({"up": math.nan}, False, "OK"), ({"ratio": math.nan, "rps": math.nan}, False, "OK"),
    ({"ratio": 0.02, "rps": 1.0, "p95": 0.8}, False, "OK"),
])
def test_rollback(spark, change, rollback, reason):
    s = {"up": 1.0, "ratio": 0.001, "rps": 0.1, "p95": 0.2} | change
    row = rollback_decision(spark.createDataFrame([("test-job", "test-ns", s["up"], s["ratio"], s["rps"], s["p95"])], SIGNALS)).first()
    assert (row.should_rollback, row.reason) == (rollback, reason)
    assert {"min_up", "ratio_5xx", "rps_5xx", "p95", "limit_min_up", "limit_p95_sec", "limit_5xx_ratio"} <= row.asDict().keys()


def test_rollback_options(spark):
    df = spark.createDataFrame([("j", "n", 1.0, None, None, 0.15)], SIGNALS)
    strict = RollbackLimits(max_p95_sec=0.1, missing_errors_as_zero=True)
    assert rollback_decision(df, strict).first().reason == "LATENCY_TOO_HIGH: p95=0.150000s (> 0.1s)"


def outcome_rows(n, seed):
    rnd = random.Random(seed)
    kinds = ["OBSERVABILITY_PARTIAL: x", "OBSERVABILITY_UNAVAILABLE: y", "OBSERVABILITY_PARTIAL: z", "OK", "ERROR_BUDGET_EXCEEDED"]
    rows = []
    for target in ("a", "b"):
        t = T0
        for _ in range(n):
            t += timedelta(minutes=rnd.choice([1, 5, 600, 3000]))
            kind = rnd.choice(kinds[:3] * 3 + kinds[3:])
            rows.append(("job", target, t, kind == "ERROR_BUDGET_EXCEEDED", kind))
    return rows


OUTCOMES = "job string, namespace string, ts timestamp, should_rollback boolean, reason string"


def counted(rows):
    state, out = {}, {}
    for job, ns, ts, rollback, reason in sorted(rows, key=lambda r: r[2]):
        state[ns] = state.get(ns, 0) + 1 if not rollback and reason.startswith("OBSERVABILITY_") else 0
        severity = "rollback" if rollback else "ok" if state[ns] == 0 else "critical" if state[ns] >= 3 else "skipped"
        out[ns, ts] = (state[ns], severity)
    return out


@pytest.mark.parametrize("chunk", [600, 86_400, 10**9])
def test_escalation_against_loop(spark, chunk):
    rows = outcome_rows(120, chunk)
    got = escalation(spark.createDataFrame(rows, OUTCOMES), chunk_sec=chunk).collect()
    assert {(r.namespace, r.ts): (r.consecutive, r.severity) for r in got} == counted(rows)


def test_convergence(spark):
    rows = [("p1", 1, "7"), ("p1", 2, "8"), ("p2", 1, "8"), ("p3", 1, "8"), ("p3", 2, "bad"), (None, 1, " 8 "), ("p4", 1, None)]
    df = spark.createDataFrame([("j", "n", p, T0 + timedelta(seconds=s), v) for p, s, v in rows],
                               "job string, namespace string, pod string, ts timestamp, served_version string")
    row = fleet_convergence(df, 8).first()
    assert (row.pods, row.ok_pods, row.converged) == (5, 3, True)
    assert not fleet_convergence(df, 8, min_pods=4).first().converged


def test_observe_end_to_end(spark):
    rows = []
    for ns, errors, slow in (("good", 0, 0), ("errors", 40, 0), ("slow", 0, 90)):
        for t in range(0, 601, 15):
            rows += [("up", {"pod": "a"}, t, 1, ns), ("http_requests_total", {"status": "200"}, t, 100 * t, ns),
                     ("http_requests_total", {"status": "500"}, t, errors * t, ns)]
            rows += [("http_request_duration_highres_seconds_bucket", {"le": le}, t, share * t, ns)
                     for le, share in (("0.5", 100 - slow), ("2", 100), ("+Inf", 100))]
    targets = spark.createDataFrame([("job", n) for n in ("good", "errors", "slow", "silent")], "job string, namespace string")
    start = epoch_us("2025-01-01T00:05:00")
    grid = EvalGrid(start, start + 120 * 1_000_000, 30 * 1_000_000)
    got = observe_with_escalation(targets, samples(spark, rows), grid).collect()
    assert len(got) == 4 * 5
    reasons = {(r.namespace, r.reason.split(":")[0]) for r in got}
    assert reasons == {("good", "OK"), ("errors", "ERROR_BUDGET_EXCEEDED"), ("slow", "LATENCY_TOO_HIGH"), ("silent", "OBSERVABILITY_UNAVAILABLE")}
    silent = sorted((r.eval_ts, r.consecutive, r.severity) for r in got if r.namespace == "silent")
    assert [s[1:] for s in silent] == [(1, "skipped"), (2, "skipped"), (3, "critical"), (4, "critical"), (5, "critical")]
    good = [r for r in got if r.namespace == "good"][0]
    assert good.rps_5xx == 0.0 and good.p95 == pytest.approx(0.475)
