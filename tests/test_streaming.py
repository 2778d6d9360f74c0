import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureops.operators.features import entity_features
from featureops.operators.materialize import ServingTable
from featureops.operators.rates import counter_rates, latency_quantile
from featureops.params import EvalGrid
from featureops.session import epoch_us
from featureops.sources.contract import parse_contract
from featureops.sources.feature_store import FeatureStore
from featureops.sources.metric_samples import SAMPLE_SCHEMA
from featureops.streaming.escalation import escalation_sink, escalations
from featureops.streaming.features import stream_features
from featureops.streaming.jobs import collected, per_batch, run_sink, serving_sink, version_sink
from featureops.streaming.rates import stream_counter_rates

from test_metrics_and_slo import OUTCOMES, counted, outcome_rows

T0 = datetime(2025, 1, 1)


def as_stream(spark, tmp_path, parts, schema):
    """One file per part, one micro-batch per file, in order."""
    path = str(tmp_path / "source")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def split_in(rows, n, by):
    rows = sorted(rows, key=by)
    return [rows[i * len(rows) // n:(i + 1) * len(rows) // n] for i in range(n)]


EVENTS = "user_id long, session_sec double, event_time timestamp"


def event_rows():
    rnd = random.Random(5)
    return [(rnd.randint(1, 4), rnd.choice([None, 10.0, 400.0]), T0 + timedelta(minutes=37 * i)) for i in range(600)]


def test_stream_features_equal_batch(spark, tmp_path):
    rows = event_rows()
    stream = as_stream(spark, tmp_path, split_in(rows, 3, lambda r: r[2]), EVENTS)
    got = collected(spark, stream_features(stream, watermark="1 hour"), "features").collect()
    closed = max(r[2] for r in rows) - timedelta(hours=1)
    ends = [T0 + timedelta(days=d) for d in range(1, 60) if T0 + timedelta(days=d) <= closed]
    assert {r.event_timestamp for r in got} == set(ends)
    end = ends[9]
    seen = {r.user_id: r for r in got if r.event_timestamp == end}
    inside = [r for r in rows if end - timedelta(days=7) <= r[2] < end]
    batch = entity_features(spark.createDataFrame(inside, EVENTS), end.isoformat()).collect()
    assert {r.user_id for r in batch} == set(seen)
    for r in batch:
        s = seen[r.user_id]
        assert (s.f_total_events_7d, s.f_last_event_age_sec, s.label) == (r.f_total_events_7d, r.f_last_event_age_sec, r.label)
        assert s.f_avg_session_sec_7d == pytest.approx(r.f_avg_session_sec_7d)


def test_stream_features_into_store(spark, tmp_path):
    stream = as_stream(spark, tmp_path, split_in(event_rows()[:250], 2, lambda r: r[2]), EVENTS)
    store = FeatureStore(spark, str(tmp_path / "fs"), "act")
    contract = parse_contract('{"feature_set": "act", "columns": [{"name": "user_id"}]}', "act")
    sink = version_sink(store, "stream", "events", contract)
    run_sink(stream_features(stream), sink, str(tmp_path / "ckpt")).awaitTermination()
    versions = [r.version for r in store.versions().orderBy("version").collect()]
    assert versions == [f"v_202501{d:02d}T090000" for d in range(2, 8)]
    assert store.read(versions[-1]).count() == 4


@pytest.mark.parametrize("window, step, chunk", [(60, 15, None), (60, 60, 20), (120, 60, 30)])
def test_stream_rates_equal_batch(spark, tmp_path, window, step, chunk):
    rnd = random.Random(window)
    rows = []
    for pod in ("a", "b"):
        v = 0
        for i in range(120):
            v = 0 if rnd.random() < 0.05 else v + rnd.randint(0, 9)
            rows.append(("http_requests_total", "job", "ns", {"pod": pod, "status": "200"}, T0 + timedelta(seconds=10 * i), float(v)))
    parts = split_in(rows, 3, lambda r: r[4])
    # out of order, but not later than the watermark allows
    parts[1].insert(0, parts[0].pop())
    stream = as_stream(spark, tmp_path, parts, SAMPLE_SCHEMA)
    rated = stream_counter_rates(stream, window, step, "30 seconds", chunk_sec=chunk)
    got = {(r.labels["pod"], r.eval_ts): r.rate for r in collected(spark, rated, "rates").collect()}
    closed = max(r[4] for r in rows) - timedelta(seconds=30)
    start = epoch_us("2025-01-01T00:00:00")
    grid = EvalGrid(start, start + 1200 * 1_000_000, step * 1_000_000)
    batch = counter_rates(spark.createDataFrame(rows, SAMPLE_SCHEMA), grid, window * 1_000_000).collect()
    want = {(r.labels["pod"], r.eval_ts): r.rate for r in batch if r.eval_ts < closed}
    assert want.keys() <= got.keys() and all(k[1] <= closed for k in got)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_late_samples_are_dropped(spark, tmp_path):
    def row(sec, v):
        return ("m", "job", "ns", {}, T0 + timedelta(seconds=sec), float(v))

    parts = [[row(10, 1), row(20, 2), row(50, 5)], [row(400, 9)], [row(410, 9)], [row(30, 1000)], [row(900, 10)]]
    stream = as_stream(spark, tmp_path, parts, SAMPLE_SCHEMA)
    rows = collected(spark, stream_counter_rates(stream, 60, 60, "30 seconds", extrapolate=False), "late").collect()
    got = {r.eval_ts: round(r.rate * 60, 6) for r in rows}
    assert got == {T0 + timedelta(seconds=60): 4.0, T0 + timedelta(seconds=420): 0.0}


def test_stream_rates_chunk_must_fit(spark, tmp_path):
    stream = as_stream(spark, tmp_path, [[]], SAMPLE_SCHEMA)
    with pytest.raises(ValueError):
        stream_counter_rates(stream, 60, 15, "1 minute", chunk_sec=10)


def test_stream_signals_see_whole_windows(spark, tmp_path):
    rows = []
    for i in range(60):
        at = T0 + timedelta(seconds=15 * i)
        for pod in ("a", "b", "c"):
            rows += [("m", "job", "ns", {"pod": pod, "le": le}, at, float(n * i)) for le, n in (("0.1", 2), ("1", 4), ("+Inf", 4))]
    stream = as_stream(spark, tmp_path, split_in(rows, 4, lambda r: r[4]), SAMPLE_SCHEMA)
    rated = stream_counter_rates(stream, 60, 30, "30 seconds")
    sink = per_batch(lambda batch: latency_quantile(batch, 0.75), str(tmp_path / "out"))
    run_sink(rated, sink, str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len({r.eval_ts for r in got}) > 20
    assert all(r.p95 == pytest.approx(0.1 + 0.9 * 0.5) for r in got)


def test_stream_into_serving_table(spark, tmp_path):
    schema = "user_id long, event_timestamp timestamp, x double"
    parts = [[(1, T0, 1.0), (2, T0, 2.0)], [(1, T0 - timedelta(days=1), 0.0), (3, T0, 3.0)], [(2, T0 + timedelta(days=1), 9.0)]]
    serving = ServingTable(spark, str(tmp_path / "serving"))
    sink = serving_sink(serving)
    run_sink(as_stream(spark, tmp_path, parts, schema), sink, str(tmp_path / "ckpt")).awaitTermination()
    want = {1: 1.0, 2: 9.0, 3: 3.0}
    assert {r.user_id: r.x for r in serving.read().collect()} == want
    sink(spark.createDataFrame([(7, T0, 7.0)], schema), 2)  # a repeated batch id
    assert {r.user_id: r.x for r in serving.read().collect()} == want


def test_stream_escalation_carries_runs(spark, tmp_path):
    rows = outcome_rows(40, 11)
    stream = as_stream(spark, tmp_path, split_in(rows, 4, lambda r: r[2]), OUTCOMES)
    base = str(tmp_path / "esc")
    sink = escalation_sink(base)
    run_sink(stream, sink, str(tmp_path / "ckpt")).awaitTermination()
    judged = {(r.namespace, r.ts): (r.consecutive, r.severity) for r in escalations(spark, base).collect()}
    assert judged == counted(rows)
    # running a batch again changes nothing
    last = spark.read.parquet(str(tmp_path / "source")).where(F.col("ts") >= sorted(rows, key=lambda r: r[2])[60][2])
    sink(last, 3)
    assert {(r.namespace, r.ts): (r.consecutive, r.severity) for r in escalations(spark, base).collect()} == counted(rows)


def test_stream_escalation_takes_counts_back(spark, tmp_path, seed=2):
    """Shuffled micro-batches: what was given out before a late row came is corrected, and only that."""
    rows = outcome_rows(40, seed)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    parts = [shuffled[i::3] for i in range(3)]
    base = str(tmp_path / "esc")
    run_sink(as_stream(spark, tmp_path, parts, OUTCOMES), escalation_sink(base, lateness_sec=10**8), str(tmp_path / "ckpt")).awaitTermination()
    assert {(r.namespace, r.ts): (r.consecutive, r.severity) for r in escalations(spark, base).collect()} == counted(rows)
    said = spark.read.parquet(f"{base}/out")
    assert len(rows) < said.count() < 3 * len(rows)
    assert spark.read.parquet(f"{base}/late").count() == 0


def test_stream_escalation_reports_what_is_too_late(spark, tmp_path):
    missing = lambda s: ("job", "ns", T0 + timedelta(seconds=s), False, "OBSERVABILITY_PARTIAL")
    parts = [[missing(0), missing(100), missing(200)], [missing(300)], [missing(50), missing(250)]]
    base = str(tmp_path / "esc")
    run_sink(as_stream(spark, tmp_path, parts, OUTCOMES), escalation_sink(base, lateness_sec=120), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.ts - T0).seconds: r.consecutive for r in escalations(spark, base).collect()}
    assert got == {0: 1, 100: 2, 200: 3, 250: 4, 300: 5}
    assert [(r.ts - T0).seconds for r in spark.read.parquet(f"{base}/late").collect()] == [50]
