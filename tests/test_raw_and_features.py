import itertools
import math
from hashlib import sha256
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException

from featureops.operators.features import align_to_contract, batch_quality, contract_columns, entity_features, label_distribution, rule_label
from featureops.params import LabelRule
from featureops.sources.contract import parse_contract, read_contract
from featureops.streaming.features import stream_features
from featureops.sources.raw_events import header_groups, raw_line_check, read_raw_events, read_typed_events, require_raw_data, typed_events
from pyspark.sql import Observation, functions as F

AS_OF = "2025-11-20T00:00:00"

DIRTY = """user_id,event_ts,session_length_sec,timestamp,note
1,2025-11-19T10:00:00,120,,x
1.9,2025-11-19 11:00:00,abc,,x
 2 ,2025-1-2T3:4:5,,,x
2,2025-11-19T10:00:00.5,10,,x
2,2025-02-30 00:00:00,10,,x
2,   ,10,2025-11-19T23:00:00,x
0,2025-11-19T10:00:00,10,,x
,2025-11-19T10:00:00,10,,x
abc,2025-11-19T10:00:00,10,,x
nan,2025-11-19T10:00:00,10,,x
inf,2025-11-19T10:00:00,10,,x
-3,,5,2025-11-19T10:00:00,x

4,2025-11-19T10:00:00,nan,,x
5,2025-11-19T10:00:00
6,2025-11-19T10:00:00,5,,x,extra
7,2025-11-19T10:00:00,,,"a ""quoted"", cell"
7,"2025-11-19T10:00:00","60",,"x,y",too,many
1.0d,2025-11-19T10:00:00,1,,x
"""


@pytest.fixture()
def raw_file(tmp_path):
    def write(text, name="events.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def built(spark, path, **kw):
    return {r.user_id: r for r in entity_features(typed_events(read_raw_events(spark, path)), AS_OF, **kw).collect()}


def test_dirty_csv(spark, raw_file):
    f = built(spark, raw_file(DIRTY))
    assert set(f) == {1, 2, -3, 4, 5, 6, 7}
    assert (f[1].f_total_events_7d, f[1].f_avg_session_sec_7d) == (2, 60.0)  # 120 and a bad cell
    assert (f[2].f_total_events_7d, f[2].f_avg_session_sec_7d) == (4, 7.5)  # the blank cell counts as 0
    # only the unpadded time parses: blanks do not fall through to the next column
    assert f[2].f_last_event_age_sec == (datetime(2025, 11, 20) - datetime(2025, 1, 1, 18, 4, 5)).total_seconds()
    assert f[-3].f_last_event_age_sec == 23 * 3600
    assert math.isnan(f[4].f_avg_session_sec_7d) and f[4].label == 0
    assert (f[5].f_total_events_7d, f[5].f_avg_session_sec_7d) == (1, 0.0)  # no cell: nothing counted
    assert f[6].f_avg_session_sec_7d == 5.0
    assert (f[7].f_total_events_7d, f[7].f_avg_session_sec_7d) == (2, 30.0)
    assert all(r.event_timestamp == datetime(2025, 11, 20) for r in f.values())


def test_short_row_is_not_averaged(spark, raw_file):
    f = built(spark, raw_file("user_id,event_ts,session_length_sec\n1,2025-11-19T10:00:00,40\n1,2025-11-19T10:00:00\n1\n"))
    assert (f[1].f_total_events_7d, f[1].f_avg_session_sec_7d) == (3, 40.0)


def test_columns_in_any_order_or_absent(spark, raw_file):
    f = built(spark, raw_file("ts,user_id\n2025-11-19T10:00:00,9\n,9\n"))
    assert (f[9].f_total_events_7d, f[9].f_avg_session_sec_7d, f[9].f_last_event_age_sec) == (2, 0.0, 23 * 3600)
    assert built(spark, raw_file("a,b\n1,2\n", "other.csv")) == {}


def test_age_without_time_or_in_future(spark, raw_file):
    f = built(spark, raw_file("user_id,ts\n1,bad\n2,2025-11-20T09:00:01\n"))
    assert (f[1].f_last_event_age_sec, f[2].f_last_event_age_sec) == (0, -1)


def test_line_check(spark, raw_file):
    assert raw_line_check(spark, raw_file(DIRTY)).first().lines == 19
    with pytest.raises(ValueError):
        require_raw_data(spark, raw_file("user_id,ts\n\n   \n", "header.csv"))
    with pytest.raises(ValueError):
        require_raw_data(spark, raw_file("", "empty.csv"))
    with pytest.raises(AnalysisException):
        read_raw_events(spark, "/nowhere/events.csv")


@pytest.mark.parametrize("n, avg, want", [
    (4, 300.0, 2), (3, 300.0, 1), (4, 299.9, 1), (1, 500.0, 0), (9, 30.0, 0), (9, 30.1, 1), (1, math.nan, 0), (9, math.nan, 1),
])
def test_label_rule(spark, n, avg, want):
    df = spark.createDataFrame([(n, avg)], "n long, a double")
    assert df.select(rule_label(F.col("n"), F.col("a"))).first()[0] == want


def test_label_thresholds_are_parameters(spark):
    df = spark.createDataFrame([(2, 10.0)], "n long, a double")
    assert df.select(rule_label(F.col("n"), F.col("a"), LabelRule(2, 10.0, 0, 1.0))).first()[0] == 2


def test_label_on_the_limit_in_any_order(spark):
    """Four sessions that average 300 seconds: active, in whatever order their doubles are met, in batches and streams."""
    orders = enumerate(itertools.permutations((899.4, 100.1, 100.2, 100.3)))
    rows = [(user, v, datetime(2024, 1, 1, 0, i)) for user, order in orders for i, v in enumerate(order)]
    df = spark.createDataFrame(rows, "user_id long, session_sec double, event_time timestamp").coalesce(1)
    for dealt in (df, df.repartition(4)):
        seen = entity_features(dealt, "2024-01-02T00:00:00").collect()
        assert [(r.f_avg_session_sec_7d, r.label) for r in seen] == [(300.0, 2)] * 24
    assert [(r.f_avg_session_sec_7d, r.label) for r in stream_features(df).collect()] == [(300.0, 2)] * 7 * 24


def test_window_days(spark):
    rows = [(1, 10.0, datetime(2025, 11, 13)), (1, 20.0, datetime(2025, 11, 13, 0, 0, 1)), (1, 30.0, datetime(2025, 11, 20)),
            (1, 40.0, datetime(2025, 11, 21)), (1, 50.0, None)]
    df = spark.createDataFrame(rows, "user_id long, session_sec double, event_time timestamp")
    assert entity_features(df, AS_OF).first().f_total_events_7d == 5
    week = entity_features(df, AS_OF, window_days=7).first()
    assert (week.f_total_events_7d, week.f_avg_session_sec_7d) == (2, 25.0)


def labelled(spark, labels):
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "user_id long, label int")


@pytest.mark.parametrize("labels, level", [
    ([], "too_few_rows"), ([1], "too_few_rows"), ([1, 1], "no_label_diversity"), ([1] * 60, "no_label_diversity"),
    ([0, 1], "weak"), ([0, 1] * 24 + [2], "weak"), ([0, 1] * 25, "ok"),
])
def test_quality_levels(spark, labels, level):
    row = batch_quality(labelled(spark, labels)).first()
    assert (row.level, row.n_rows, row.labels) == (level, len(labels), sorted(set(labels)))


def test_label_distribution(spark):
    assert [tuple(r) for r in label_distribution(labelled(spark, [2, 0, 2])).collect()] == [(0, 1), (2, 2)]


def test_contract_order():
    assert contract_columns(["user_id", "a"]) == ["user_id", "a", "label", "event_timestamp"]
    assert contract_columns(["event_timestamp", "user_id", "a"]) == ["event_timestamp", "user_id", "label", "a"]
    assert contract_columns(["label", "user_id"]) == ["label", "user_id", "event_timestamp"]


def test_unknown_contract_column_is_null(spark):
    row = align_to_contract(labelled(spark, [1]).withColumn("event_timestamp", F.lit(None)), ["user_id", "new"]).first()
    assert row.asDict() == {"user_id": 0, "new": None, "label": 1, "event_timestamp": None}


def test_contract_document(spark, tmp_path):
    text = '{"feature_set": "f", "columns": [{"name": "user_id", "type": "long"}, {"name": "\u00e9"}]}'
    other = '{"columns": [{"type": "long", "name": "user_id"}, {"name": "\\u00e9"}],\n "feature_set": "f"}'
    assert parse_contract(text, "f").fingerprint == parse_contract(other, "f").fingerprint
    # SHA-256 of the compact document with sorted keys and unescaped characters
    compact = b'{"columns":[{"name":"user_id"}],"feature_set":"f"}'
    assert parse_contract('{"feature_set":"f","columns":[{"name":"user_id"}]}', "f").fingerprint == sha256(compact).hexdigest()
    with pytest.raises(ValueError):
        parse_contract(text, "g")
    with pytest.raises(ValueError):
        parse_contract('{"feature_set": "f", "columns": [{"name": "x"}]}', "f")
    path = tmp_path / "c.json"
    path.write_text(text, encoding="utf-8")
    assert read_contract(spark, str(path), "f") == parse_contract(text, "f")


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,event_ts,session_length_sec\n1,2025-11-19T10:00:00,60\n")
    (folder / "b.csv").write_text("user_id,event_ts,session_length_sec\n1,2025-11-19T11:00:00,20\n")
    assert built(spark, str(folder))[1].f_avg_session_sec_7d == 40.0
    (folder / "c.csv").write_text("session_length_sec,user_id,event_ts\n60,1,2025-11-19T10:00:00\n")
    with pytest.raises(Exception, match="header"):
        built(spark, str(folder))


def test_cells_of_long_and_quoted_lines(spark, raw_file):
    lines = ["user_id,event_ts,note", "1,x," + "," * 19_000, '2,"a,b","c ""d, e"" f",g', '3,x,"never, closed, at all', "4"]
    rows = read_raw_events(spark, raw_file("\n".join(lines) + "\n")).select("user_id", "_cells").collect()
    assert {r.user_id: r._cells for r in rows} == {"1": 19_003, "2": 4, "3": 3, "4": 1}


def test_unnamed_header_cells_are_read(spark, raw_file):
    f = built(spark, raw_file("user_id,event_ts,session_length_sec,\n1,2025-11-19T10:00:00,60,\n"))
    assert f[1].f_avg_session_sec_7d == 60.0


def test_files_of_several_headers(spark, tmp_path, capsys):
    """Columns are bound by name in each file; short rows, blank cells and extra cells keep their meaning; one scan."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,event_ts,session_length_sec\n1,2025-11-19T10:00:00,120\n2,2025-11-19T10:00:00,\n3,2025-11-19T10:00:00\n")
    (folder / "b.csv").write_text('session_length_sec,extra,user_id,ts\r\n60,"x, ""y""",1,2025-11-19 11:00:00\r\n,z,2\r\n\r\n7,z,4,2025-11-19 11:00:00,more,cells\r\n')
    (folder / "c.csv").write_text("\n  \nuser_id\n1\n")
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text("user_id,event_ts,session_length_sec\n5,,9\n")
    groups = {tuple(names): len(files) for names, files in header_groups(spark, str(folder))}
    assert groups == {("user_id", "event_ts", "session_length_sec"): 2, ("session_length_sec", "extra", "user_id", "ts"): 1, ("user_id",): 1}
    seen = Observation()
    typed = read_typed_events(spark, str(folder), lines=seen)
    got = sorted(((r.user_id, r.session_sec, r.event_time is not None) for r in typed.collect()), key=str)
    assert got == sorted([(1, 120.0, True), (2, 0.0, True), (3, None, True), (1, 60.0, True), (2, 0.0, False), (4, 7.0, True), (1, None, False), (5, 9.0, False)], key=str)
    assert seen.get["lines"] == raw_line_check(spark, str(folder)).first().lines == 12
    typed.explain()
    assert capsys.readouterr().out.count("FileScan text") == 3  # each file once, in the scan of its group


def test_single_header_reads_agree(spark, raw_file):
    text = 'user_id,event_ts,session_length_sec\n1,2025-11-19T10:00:00,120\n1.9,2025-11-19 10:00:00,abc\n 2 ,2025-1-2T3:4:5,\n5,x\n6,y,5,9\n"7","2025-11-19T10:00:00","1,5"\n'
    path = raw_file(text)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(read_typed_events(spark, path)) == rows(typed_events(read_raw_events(spark, path)))
    assert read_typed_events(spark, raw_file("", "none.csv")).count() == 0
