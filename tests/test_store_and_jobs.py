from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureops.operators.materialize import ServingTable, latest_per_entity, materialize_full, materialize_incremental
from featureops.params import DriftLimits
from featureops.plans.feature_job import build_version, gate_version, release_version
from featureops.sources.contract import parse_contract
from featureops.sources.feature_store import FeatureStore, VersionExists, with_utc_event_time

CONTRACT = parse_contract(
    '{"feature_set": "act", "columns": [{"name": "user_id"}, {"name": "f_total_events_7d"}, {"name": "f_avg_session_sec_7d"},'
    ' {"name": "f_last_event_age_sec"}, {"name": "label"}, {"name": "event_timestamp"}]}', "act")


def raw_csv(path, users, scale=1.0):
    lines = ["user_id,event_ts,session_length_sec"]
    for u in range(1, users + 1):
        for k in range(u % 3 * 3 + 1):
            lines.append(f"{u},2025-11-{10 + k:02d}T10:00:00,{(u * 7 % 500 + k) * scale}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture()
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "fs"), "act")


def test_versions_and_release(spark, store, tmp_path):
    assert store.latest() is None and store.versions().isEmpty()
    first = build_version(spark, raw_csv(tmp_path / "a.csv", 300), store, CONTRACT, "2025-11-20T00:00:00", "nightly", csv_copy=True)
    assert first.version == "v_20251120T090000" and first.quality.first().level == "ok"
    assert gate_version(store, first.version).first().reason.startswith("DRIFT_SKIPPED")

    released = release_version(store, first.version, "2025-11-20T01:00:00", str(tmp_path / "runs"), str(tmp_path / "model"), env="dev")
    assert released.decision.first().decision == "promote" and store.latest() == first.version

    second = build_version(spark, raw_csv(tmp_path / "b.csv", 280, 3.0), store, CONTRACT, "2025-11-21T00:00:00", "nightly")
    assert store.previous(second.version) == first.version and store.previous(first.version) is None
    for limits in (DriftLimits(sample_n=200), DriftLimits()):
        gate = gate_version(store, second.version, limits).first()
        assert gate.block_promotion and gate.worst_col in ("f_avg_session_sec_7d", "f_last_event_age_sec")
    blocked = release_version(store, second.version, "2025-11-21T01:00:00", str(tmp_path / "runs"), str(tmp_path / "model2"))
    assert blocked.decision.first().shadow_reason == "drift_detected" and blocked.decision.first().drift_reason.startswith("DRIFT_BLOCK")
    assert store.latest() == first.version  # not published
    assert [p.name.startswith("run=") for p in (tmp_path / "model").iterdir()] == [True]
    third = build_version(spark, raw_csv(tmp_path / "c.csv", 280, 3.0), store, CONTRACT, "2025-11-22T00:00:00", "nightly")
    assert store.previous(third.version) == first.version  # a blocked batch is no baseline
    again = gate_version(store, third.version).first()
    assert again.block_promotion and again.signals["f_avg_session_sec_7d"] > 0.2
    runs = spark.read.json(str(tmp_path / "runs"))
    assert runs.count() == 2 and set(runs.columns) >= {"accuracy", "fs_version", "status"}

    stored = store.read(second.version)
    assert stored.columns == list(CONTRACT.columns) and stored.count() == 280
    assert {r.version: r["count"] for r in store.read_all().groupBy("version").count().collect()} == {first.version: 300, second.version: 280, third.version: 280}
    row = store.run_summary("nightly").orderBy("version").first()
    assert row.version == first.version and row.raw_path.endswith("a.csv")
    lineage = store.versions().orderBy("version").first()
    assert lineage.schema_hash == CONTRACT.fingerprint and lineage.generated_at == datetime(2025, 11, 20)
    with pytest.raises(VersionExists):
        store.write(stored, "2025-11-21T00:00:00", "nightly", "x", CONTRACT)
    copy = spark.read.option("header", True).csv(f"{store.base}/act/csv/version={first.version}")
    assert copy.columns == list(CONTRACT.columns) and copy.count() == 300


def test_half_written_version_is_invisible(spark, store):
    rows = spark.range(3).select(F.col("id").alias("user_id"), F.lit(1).alias("label"))
    store.write(rows, "2025-11-20T00:00:00", "p", "s", CONTRACT)
    rows.write.parquet(store.feature_uri("v_20251122T000000"))  # no lineage row: a job that died
    assert store.read_all().count() == 3 and store.previous("v_20251123T000000") is None
    store.publish("v_20251120T090000", "2025-11-20T01:00:00")
    assert store.previous("v_20251123T000000") == "v_20251120T090000"
    store.write(rows, "2025-11-21T15:00:00", "p", "s", CONTRACT)
    assert store.read_all().count() == 6


def test_event_time_column(spark):
    texts = spark.createDataFrame([("2025-11-20T09:00:00+09:00",)], "event_timestamp string")
    assert with_utc_event_time(texts, 0).first()[0] == datetime(2025, 11, 20)
    assert with_utc_event_time(texts.select(F.lit(1).alias("x")), "2025-11-20T00:00:00").first()[1] == datetime(2025, 11, 20)
    with pytest.raises(Exception):
        with_utc_event_time(texts.withColumn("event_timestamp", F.lit("soon")), 0).collect()


T0 = datetime(2026, 1, 1)


def history(spark, rows):
    return spark.createDataFrame([(u, v, T0 + timedelta(days=d), x) for u, d, v, x in rows],
                                 "user_id long, version string, event_timestamp timestamp, x double")


ROWS = [(1, 0, "a", 1.0), (1, 2, "b", 2.0), (1, 2, "c", 3.0), (2, 1, "a", 4.0), (3, -1, "a", 5.0), (4, 9, "z", 6.0), (1, 5, "d", 7.0)]


def test_materialize(spark):
    rows = history(spark, ROWS)
    full = {r.user_id: r.x for r in materialize_full(rows, "2026-01-04T00:00:00").collect()}
    assert full == {1: 3.0, 2: 4.0}  # version breaks the tie; user 3 is before the start, 4 after the end
    assert {r.user_id: r.x for r in materialize_full(rows, "2026-01-03T00:00:00", "2026-01-01T00:00:00").collect()} == {1: 3.0, 2: 4.0}
    now = materialize_incremental(materialize_full(rows, "2026-01-04T00:00:00"), rows, "2026-01-04T00:00:00", "2026-01-10T00:00:00")
    assert {r.user_id: r.x for r in now.collect()} == {1: 7.0, 2: 4.0, 4: 6.0}
    assert latest_per_entity(rows).columns == rows.columns


def test_serving_table(spark, tmp_path):
    serving = ServingTable(spark, str(tmp_path / "serving"))
    rows = history(spark, ROWS)
    serving.advance(rows, "2026-01-04T00:00:00")  # no mark yet: a full refresh
    assert {r.user_id: r.x for r in serving.read().collect()} == {1: 3.0, 2: 4.0}
    serving.advance(rows, "2026-01-10T00:00:00")
    assert {r.user_id: r.x for r in serving.read().collect()} == {1: 7.0, 2: 4.0, 4: 6.0}
    late = history(spark, [(9, 0, "a", 1.0)])  # before the mark: not picked up until a full refresh
    assert serving.advance(rows.union(late), "2026-01-11T00:00:00").count() == 3
    assert serving.refresh(rows.union(late), "2026-01-11T00:00:00").count() == 4


def test_versions_with_other_columns_are_read_together(spark, store):
    contract = parse_contract('{"feature_set": "act", "columns": [{"name": "user_id"}, {"name": "f_x"}]}', "act")
    store.write(spark.sql("SELECT 1L AS user_id, 2.0D AS f_x, 3.0D AS f_old"), "2025-01-01T00:00:00", "p", "s", contract)
    store.write(spark.sql("SELECT 1L AS user_id, 2.0D AS f_x, 4.0D AS f_new"), "2025-01-02T00:00:00", "p", "s", contract)
    rows = store.read_all().orderBy("version").collect()
    assert [(r.f_old, r.f_new) for r in rows] == [(3.0, None), (None, 4.0)]


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_serving_increment_touches_its_buckets_only(spark, tmp_path):
    serving = ServingTable(spark, str(tmp_path / "serving"), buckets=50, fold_every=3)
    rows = spark.range(2_000).selectExpr("id AS user_id", "TIMESTAMP '2026-01-02' AS event_timestamp", "'a' AS version", "CAST(id AS DOUBLE) AS x")
    serving.refresh(rows, "2026-01-03T00:00:00")
    want = {i: float(i) for i in range(2_000)}
    before = files_of(tmp_path / "serving")
    for n in range(1, 6):  # 1 % of the entities each time
        fresh = rows.where(f"user_id % 1000 = {n} OR user_id IN (7, {3_000 + n})").selectExpr(
            "user_id", f"TIMESTAMP '2026-01-03' + INTERVAL {n} HOUR AS event_timestamp", "'b' AS version", f"CAST({n} AS DOUBLE) AS x", f"{n} AS added")
        serving.advance(fresh.unionByName(rows, allowMissingColumns=True), f"2026-01-03T{n:02d}:00:00")
        want |= {i: float(n) for i in (n, n + 1000, 7)}
        new = {f for f in files_of(tmp_path / "serving") if f not in before}
        assert {f.split("/")[1] for f in new} == {f"snapshot={n + 1}"}
        touched = {f.split("/")[2] for f in new}
        assert len(touched) <= 3
        # the third delta of a bucket is folded into a new base
        manifest = serving.manifest(n + 1)
        assert all(len(deltas) < 3 for _, deltas in manifest.values())
        before = files_of(tmp_path / "serving")
        assert {r.user_id: r.x for r in serving.read().collect()} == want
    assert any(f.startswith("base/snapshot=4/") for f in before)


def test_serving_table_without_rows_and_marks(spark, tmp_path):
    serving = ServingTable(spark, str(tmp_path / "serving"), buckets=4)
    with pytest.raises(ValueError):
        serving.read()
    rows = history(spark, ROWS)
    assert serving.refresh(rows, "2025-01-01T00:00:00", "2024-01-01T00:00:00").count() == 0
    serving.merge(history(spark, [(1, 0, "a", 1.0), (2, 3, "a", 2.0)]), 2)
    # the mark is the newest event time: what is before is not read again
    late = history(spark, [(3, 1, "a", 3.0), (4, 4, "a", 4.0)])
    assert {r.user_id: r.x for r in serving.advance(late, "2026-02-01T00:00:00").collect()} == {1: 1.0, 2: 2.0, 4: 4.0}


def test_windows_become_versions_in_one_write(spark, store):
    contract = parse_contract('{"feature_set": "act", "columns": [{"name": "user_id"}]}', "act")
    rows = spark.range(300).selectExpr("id AS user_id", "TIMESTAMP '2026-01-01' + make_interval(0, 0, 0, CAST(id % 5 AS INT)) AS event_timestamp", "CAST(id AS DOUBLE) AS f_x")
    first = store.write_windows(rows.where("id % 5 < 3"), "stream", "events", contract)
    assert first == [f"v_202601{d:02d}T090000" for d in (1, 2, 3)]
    before = {r.f: r.m for r in store.read_all().selectExpr("input_file_name() AS f", "1 AS m").distinct().collect()}
    # two more windows; the finished ones come again and stay as they are
    assert store.write_windows(rows.withColumn("f_x", F.lit(-1.0)), "stream", "events", contract) == ["v_20260104T090000", "v_20260105T090000"]
    stored = store.read_all()
    assert before.keys() <= {r.f for r in stored.selectExpr("input_file_name() AS f").distinct().collect()}
    assert {r.version: (r.n, r.bad) for r in stored.groupBy("version").agg(F.count("*").alias("n"), F.count_if(F.col("f_x") < 0).alias("bad")).collect()} == {
        v: (60, 60 * (v > "v_20260103T090000")) for v in [*first, "v_20260104T090000", "v_20260105T090000"]}
    lineage = {r.version: r for r in store.versions().collect()}
    assert all(r.min_event_time == r.max_event_time == r.generated_at for r in lineage.values()) and len(lineage) == 5
    assert store.write_windows(rows, "stream", "events", contract) == []


def test_time_range_lists_overlapping_versions_only(spark, store):
    contract = parse_contract('{"feature_set": "act", "columns": [{"name": "user_id"}]}', "act")
    rows = spark.range(50).selectExpr("id AS user_id", "TIMESTAMP '2026-01-01' + make_interval(0, 0, 0, CAST(id % 10 AS INT)) AS event_timestamp")
    store.write_windows(rows, "p", "s", contract)
    part = store.read_all("2026-01-03T00:00:00", "2026-01-04T12:00:00")
    assert {f.split("version=")[1][:11] for f in part.inputFiles()} == {"v_20260103T", "v_20260104T"}
    assert part.count() == 10 and store.read_all("2027-01-01T00:00:00").count() == 0 and store.read_all(end="2026-01-02T00:00:00").count() == 10
