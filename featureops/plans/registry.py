"""Queries over the given tables, one per operator. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.parse import first_non_empty, float_or_zero, int_or_zero, wall_clock_to_instant
from ..functions.ranking import exact_sample
from ..operators import drift, evaluation, features, materialize, promotion, rates, slo, training
from ..params import (
    LATENCY_METRIC, REQUESTS_METRIC, TIME_COL, UP_METRIC, WALL_CLOCK_OFFSET, EvalGrid, RollbackLimits, RunSource,
)
from ..session import configure, epoch_us, scratch_path, written
from ..sources.contract import parse_contract
from ..sources.feature_store import FeatureStore, with_utc_event_time
from ..sources.raw_events import non_blank_lines, read_typed_events
from ..streaming.escalation import escalation_sink, escalations
from ..streaming.features import stream_features
from ..streaming.decisions import decision_sink
from ..streaming.jobs import collected, per_batch, run_sink, with_open_windows
from ..streaming.rates import stream_counter_rates, stream_rates as streamed_rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-02-01T00:00:00"
HALF = "2024-01-16"
HOUR = 3_600_000_000
STEP = 6 * HOUR
ERROR_WINDOW, LATENCY_WINDOW, LOOKBACK = 18 * HOUR, 12 * HOUR, 3 * HOUR
BOUNDS = (10, 25, 50, 100, 250)
# Event tables are sparse, so the limits are scaled down to what they can reach.
LIMITS = RollbackLimits(max_5xx_ratio=0.00025, max_5xx_rps=0.00025, max_p95_sec=200.0)
DAY_KEY = ["user_id", "day"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("user_id") != 0).select(
        "user_id", (F.col("value") * 6).alias("session_sec"), F.col("ts").cast("timestamp").alias("event_time")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).withColumn("day", F.to_date("event_time"))
    return features.entity_features(daily, AS_OF, entity=DAY_KEY)


def rounded(c: Column, digits: int = 6) -> Column:
    """Engines disagree on ties (averages over 64 rows have them); moved up a little, none is left."""
    return F.round(c + 10.0 ** -(digits + 2), digits)


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to 6 digits, dates as text: comparable between engines."""
    out = []
    for name in names or df.columns:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        out.append({"double": rounded(c), "date": c.cast("string"), "timestamp": F.unix_seconds(c)}.get(kind, c).alias(name))
    return df.select(*out)


FEATURES = ("f_total_events_7d", "f_avg_session_sec_7d", "f_last_event_age_sec", "label")

# --- raw text ---------------------------------------------------------------------------------


@query
def raw_nonblank_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(non_blank_lines(F.col("text"))).alias("lines"))
    return lines.withColumn("has_data", F.col("lines") > 1)


def dirty_number() -> Column:
    n, user, value = F.col("event_id") % 16, F.col("user_id").cast("string"), F.col("value").cast("string")
    texts = [
        user, F.concat(F.lit("  "), user, F.lit("\t")), F.concat(user, F.lit(".9")), F.concat(F.lit("-"), user, F.lit(".7")),
        F.lit("abc"), F.lit(""), F.lit(None), F.lit("nan"), F.lit("-Inf"), F.lit("1.0d"), F.lit("1_0"), F.lit(".5"),
        F.lit("+5."), F.concat(value, F.lit("e1")), F.lit("0x1p3"), value,
    ]
    chosen = F.when(n == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        chosen = chosen.when(n == i, text)
    return chosen


@query
def parse_dirty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "events").select("event_id", dirty_number().alias("s"))
    number = float_or_zero(F.col("s"))
    return dirty.select(
        "event_id",
        int_or_zero(F.col("s")).alias("as_int"),
        F.when(F.isnan(number), "nan").when(number == float("-inf"), "-inf").otherwise("number").alias("kind"),
        F.round(F.when(F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number), 6).alias("as_float"),
    )


def dirty_times() -> list[Column]:
    n, ts = F.col("event_id") % 8, F.col("ts").cast("timestamp")
    first = (
        F.when(n == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 2, F.date_format(ts, " yyyy-M-d'T'H:m:s "))
        .when(n == 3, F.date_format(ts, "yyyy-MM-dd  HH:mm:ss"))
        .when(n == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(n == 5, "  ")
        .when(n == 6, "")
    )
    second = F.when(n >= 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return [first.alias("event_ts"), second.alias("timestamp")]


@query
def parse_event_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select("event_id", *dirty_times())
    parsed = wall_clock_to_instant(first_non_empty(F.col("event_ts"), F.col("timestamp")))
    return texts.select("event_id", F.coalesce(F.unix_seconds(parsed), F.lit(-1)).alias("epoch_sec"))


@query
def raw_csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty event text written as CSV under two headers, read back in one scan and turned into features."""
    path = scratch_path(spark, "raw-csv")
    event_ts, timestamp = dirty_times()
    session = F.when(F.col("event_id") % 5 == 0, "abc").when(F.col("event_id") % 5 == 1, "").otherwise(
        F.col("value").cast("string")
    )
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 9 == 0, "?").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        event_ts,
        session.alias("session_length_sec"),
        timestamp,
        (F.col("event_id") % 2 == 0).alias("even"),
    )
    for even, order in ((True, ["user_id", "event_ts", "session_length_sec", "timestamp"]), (False, ["timestamp", "session_length_sec", "event_ts", "user_id"])):
        rows.where(F.col("even") == even).select(*order).write.mode("append").option("header", True).option("emptyValue", "").option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return shown(features.entity_features(read_typed_events(spark, path), AS_OF), "user_id", *FEATURES)


@query
def raw_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end early beside lines with a blank cell: only the missing cell stays out of the average."""
    path = scratch_path(spark, "short-rows")
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    line = F.when(kind == 1, user).when(kind == 2, F.concat(user, F.lit(","))).when(kind == 3, F.concat(user, F.lit(","), F.col("value").cast("string"), F.lit(",more")))
    rows = table(spark, sf_dir, "events").select(F.coalesce(line, F.concat(user, F.lit(","), F.col("value").cast("string"))).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The header on top of every file."""
        yield pa.RecordBatch.from_pydict({"value": ["user_id,session_length_sec"]})
        yield from batches

    rows.mapInArrow(headed, "value string").write.text(path)
    built = features.entity_features(read_typed_events(spark, path), AS_OF)
    return shown(built, "user_id", "f_total_events_7d", "f_avg_session_sec_7d", "label")


# --- features ---------------------------------------------------------------------------------


@query
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.entity_features(events(spark, sf_dir), AS_OF), "user_id", *FEATURES)


@query
def user_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(day_features(spark, sf_dir), *DAY_KEY, *FEATURES)


@query
def user_features_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = features.entity_features(events(spark, sf_dir), "2024-01-20T00:00:00", window_days=7)
    return shown(built, "user_id", *FEATURES)


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_distribution(day_features(spark, sf_dir))


@query
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.batch_quality(day_features(spark, sf_dir)).select(
        "n_rows", "n_labels", F.array_join("labels", ",").alias("labels"), "level"
    )


CONTRACT = """{"feature_set": "activity", "columns": [
  {"name": "user_id"}, {"name": "f_avg_session_sec_7d"}, {"name": "segment"},
  {"name": "f_total_events_7d"}, {"name": "f_last_event_age_sec"}]}"""


@query
def schema_aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = parse_contract(CONTRACT, "activity")
    built = features.entity_features(events(spark, sf_dir), AS_OF)
    aligned = features.align_to_contract(built, contract.columns)
    order = ",".join(aligned.columns)
    return shown(aligned.withColumn("segment", F.coalesce("segment", F.lit("-")))).withColumn("column_order", F.lit(order))


@query
def feature_store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored versions read back, with the version each would be compared with."""
    store = FeatureStore(spark, scratch_path(spark, "store"), "activity")
    contract = parse_contract(CONTRACT, "activity")
    for run, days in (("2024-01-20T00:00:00", 7), (AS_OF, None)):
        built = features.entity_features(events(spark, sf_dir), run, window_days=days)
        store.write(features.align_to_contract(built, contract.columns), run, "nightly", sf_dir, contract)
    ids = store.versions().select(
        "version", F.coalesce(F.lag("version").over(Window.orderBy("version")), F.lit("-")).alias("previous")
    )
    return shown(store.read_all().join(ids, "version"), "version", "previous", "user_id", *FEATURES)


@query
def feature_store_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage, publication and run summary of two versions: the first one is published, so the second has a baseline."""
    store = FeatureStore(spark, scratch_path(spark, "store"), "activity")
    contract = parse_contract(CONTRACT, "activity")
    ids = []
    for run, days in (("2024-01-20T00:00:00", 7), (AS_OF, None)):
        built = features.entity_features(events(spark, sf_dir), run, window_days=days)
        ids.append(store.write(features.align_to_contract(built, contract.columns), run, "nightly", "events", contract, csv_copy=True))
        if len(ids) == 1:
            store.publish(ids[0], run)
    copies = spark.read.option("header", True).csv(f"{store.base}/activity/csv").groupBy("version").agg(F.count("*").alias("csv_rows"))
    counts = store.read_all().groupBy("version").agg(F.count("*").alias("n_rows"))
    summary = store.run_summary("nightly").select("version", "raw_path")
    return store.versions().join(counts, "version").join(copies, "version").join(summary, "version").select(
        "version", "pipeline", "source", "raw_path", "feature_set", "schema_hash", "n_rows", "csv_rows",
        F.unix_seconds("generated_at").alias("generated_sec"), F.unix_seconds("min_event_time").alias("min_sec"),
        F.unix_seconds("max_event_time").alias("max_sec"), (F.col("version") == store.latest()).alias("is_latest"),
        F.when(F.col("version") == ids[1], F.lit(store.previous(ids[1]))).otherwise(F.coalesce(F.lit(store.previous(ids[0])), F.lit("-"))).alias("baseline"),
    )


@query
def feature_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times that come as ISO texts with a zone, as instants; and the stamp of rows without any."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    texts = rows.select("event_id", F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")).alias(TIME_COL))
    read = with_utc_event_time(texts, AS_OF).select("event_id", F.unix_seconds(TIME_COL).alias("event_sec"))
    stamped = with_utc_event_time(rows.select("event_id"), AS_OF).select("event_id", F.unix_seconds(TIME_COL).alias("stamp_sec"))
    return read.join(stamped, "event_id")


# --- drift ------------------------------------------------------------------------------------


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two feature batches, stored first as in production: the comparison scans them several times."""
    rows = written(day_features(spark, sf_dir), "halves")
    return rows.where(F.col("day") >= F.lit(HALF).cast("date")), rows.where(F.col("day") < F.lit(HALF).cast("date"))


def shifted_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new, ref = halves(spark, sf_dir)
    return new.withColumns({c: F.col(c) * 3 for c in FEATURES[:3]}), ref


def halves_ks(new: DataFrame, ref: DataFrame) -> DataFrame:
    return drift.ks_full(new, ref, drift.common_columns(new, ref))


def shown_decision(decision: DataFrame) -> DataFrame:
    return shown(decision, "block_promotion", "reason", "worst_col", "worst_ks")


@query
def drift_ks_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(halves_ks(*halves(spark, sf_dir)))


@query
def drift_ks_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a large table, by the bucket plan."""
    rows = table(spark, sf_dir, "lineitem")
    is_new = F.coalesce(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(False))
    columns = drift.numeric_columns(rows.schema)
    return shown(drift.ks_full(rows.where(is_new), rows.where(~is_new), columns))


@query
def drift_ks_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``drift_ks_full`` against a stored profile of the reference part."""
    rows = table(spark, sf_dir, "lineitem")
    is_new = F.coalesce(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(False))
    profile = written(drift.drift_profile(rows.where(~is_new)), "profile")
    new = rows.where(is_new)
    return shown(drift.ks_from_profile(new, profile, rows.where(~is_new), drift.profiled_columns(new, profile)))


@query
def sampled_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, ref = (exact_sample(side, 2000, DAY_KEY, 42) for side in halves(spark, sf_dir))
    return shown(drift.ks_by_column(new, ref, drift.common_columns(new, ref)))


@query
def drift_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(drift.top_columns(halves_ks(*halves(spark, sf_dir)), 5), "col_name", "ks")


@query
def drift_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_decision(drift.drift_decision(halves_ks(*halves(spark, sf_dir))))


@query
def drift_decision_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_decision(drift.drift_decision(halves_ks(*shifted_halves(spark, sf_dir))))


SHIFTS = [(c, factor) for factor in range(3, 11) for c in FEATURES[:3]]


@query
def drift_block_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature of the newer half scaled by 3 to 10, one case a column: is the batch blocked, and which is worst?"""
    new, ref = halves(spark, sf_dir)
    cases = [(f"{c}_x{k}", c, k) for c, k in SHIFTS]
    ks = drift.ks_full(new.select(*[(F.col(c) * k).alias(n) for n, c, k in cases]), ref.select(*[F.col(c).alias(n) for n, c, _ in cases]), [n for n, _, _ in cases])
    return shown(ks, "col_name", "n_new", "n_ref", "ks").withColumn("block_promotion", F.col("ks") > 0.2)


@query
def drift_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate where there is no baseline, and where the batches share no numeric column."""
    new, ref = halves(spark, sf_dir)
    first = drift.drift_gate(new, None, DAY_KEY, spark)
    apart = drift.drift_gate(new.select("user_id"), ref.select(F.col("label").alias("other")), DAY_KEY, spark)
    signals = F.array_join(F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))), ",")
    return first.unionByName(apart).select("block_promotion", "reason", "worst_col", signals.alias("signals"))


# --- training ---------------------------------------------------------------------------------


@query
def train_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_check(day_features(spark, sf_dir)).select(
        "status", "reason", "n_rows", "n_classes", "min_class_rows"
    )


@query
def training_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason for which a batch is not trained on, each from a part of the user-day features."""
    rows = written(day_features(spark, sf_dir), "training")
    cut = F.row_number().over(Window.partitionBy("label").orderBy(*DAY_KEY))
    few = rows.withColumn("_n", cut).where((F.col("label") == 1) | (F.col("_n") <= 2)).drop("_n")
    cases = [
        ("no feature", rows.drop(FEATURES[1])), ("no label", rows.drop("label")), ("few rows", rows.withColumn("_n", cut).where("_n <= 6").drop("_n")),
        ("one class", rows.where("label = 1")), ("small class", few), ("good", rows),
    ]
    checked = [
        training.training_check(df).select(F.lit(name).alias("batch"), "status", "reason", "n_rows", F.coalesce("min_class_rows", F.lit(-1)).alias("min_class_rows"))
        for name, df in cases
    ]
    return reduce(DataFrame.unionByName, checked)


@query
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split without classes, as for batches that can't be stratified."""
    rows = training.split(day_features(spark, sf_dir), DAY_KEY, stratify=False)
    return shown(rows, *DAY_KEY, "is_test")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.split(day_features(spark, sf_dir), DAY_KEY)
    return shown(rows, *DAY_KEY, "label", "is_test")


@query
def stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.split(day_features(spark, sf_dir), DAY_KEY)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluation.classification_metrics(table(spark, sf_dir, "labels"), "quality", "toxic"))


def trained(spark: SparkSession, sf_dir: str) -> training.TrainResult:
    return training.train(written(day_features(spark, sf_dir), "training"), DAY_KEY, RunSource(sf_dir), AS_OF)


@query
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows with the class probabilities of a freshly trained model that was stored and loaded again."""
    result, path = trained(spark, sf_dir), scratch_path(spark, "model")
    training.save_model(spark, result.model, path)
    model = training.load_model(spark, path)
    training.smoke_check(model, spark)
    by_class = F.map_from_arrays(F.array(*[F.lit(k) for k in model.labels]), "probability")
    chances = [rounded(F.coalesce(by_class[k], F.lit(0.0)), 4).alias(f"p_{k}") for k in range(3)]
    rows = result.scored_test.drop("prediction", "probability")
    return training.score(model, rows).select("user_id", F.col("day").cast("string").alias("day"), "label", "prediction", *chances)


@query
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of the held-out rows, as the run records them."""
    run = trained(spark, sf_dir).run
    return run.select("status", "train_rows", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("f1_macro")).alias("f1_macro"))


@query
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(day_features(spark, sf_dir), "training")
    run = training.train(rows, DAY_KEY, RunSource("features", "v1"), AS_OF).run
    return run.select("status", "fs_version", "C", "max_iter", "feature_cols", "train_rows", "train_classes", "n_features", "n_classes")


@query
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 11
    accuracy = F.when(n == 0, F.lit(None)).when(n == 1, "abc").when(n == 2, "NaN").otherwise(
        F.concat(F.col("c_acctbal").cast("string"), F.lit("e-4"))
    )
    flag = F.col("c_custkey") % 13
    drift_flag = F.when(flag == 0, " TRUE ").when(flag == 1, "on").when(flag == 2, "no").when(flag == 3, "False")
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), accuracy.alias("accuracy"), drift_flag.alias("drift_block")
    )
    return promotion.promotion_decision(runs).select(
        "run_id", "decision", F.coalesce("shadow_reason", F.lit("-")).alias("shadow_reason")
    )


# --- metrics ----------------------------------------------------------------------------------


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly scrapes of counters, latency buckets and an up gauge that the events stand for.

    12 pods restart every ten days (counters fall to zero). Events are reduced to (pod, hour)
    before anything is ordered.
    """
    value = F.col("value")
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % 3).alias("ns"),
            (F.col("user_id") % 4).alias("pod"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"),
        )
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("event_type") == "error").alias("err"),
            *[F.count_if(value <= b).alias(f"le_{b}") for b in BOUNDS],
        )
    )
    life = Window.partitionBy("ns", "pod", F.floor((F.dayofmonth("hour") - 1) / 10)).orderBy("hour")
    names = ["n", "err", *[f"le_{b}" for b in BOUNDS]]
    grown = hourly.withColumns({f"c_{c}": F.sum(c).over(life).cast("double") for c in names})
    pod = F.concat(F.lit("pod-"), F.col("pod").cast("string"))

    def sample(metric: str, count: Column, **labels: str) -> Column:
        pairs = [F.lit("pod"), pod]
        for k, v in labels.items():
            pairs += [F.lit(k), F.lit(v)]
        return F.struct(F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), count.alias("value"))

    # namespace 2 reports no failures at all: its error series do not exist
    failures = F.when(F.col("ns") != 2, F.array(sample(REQUESTS_METRIC, F.col("c_err"), status="500"))).otherwise(F.array())
    always = F.array(
        sample(REQUESTS_METRIC, F.col("c_n") - F.col("c_err"), status="200"),
        *[sample(LATENCY_METRIC, F.col(f"c_le_{b}"), le=str(b)) for b in BOUNDS],
        sample(LATENCY_METRIC, F.col("c_n"), le="+Inf"),
        sample(UP_METRIC, F.when((F.col("err") == F.col("n")) & (F.col("n") >= 2), 0.0).otherwise(1.0)),
    )
    return grown.select(
        F.lit("web").alias("job"),
        F.concat(F.lit("ns-"), F.col("ns").cast("string")).alias("namespace"),
        (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        F.inline(F.concat(always, failures)),
    )


def data_grid(spark: SparkSession, sf_dir: str, step_us: int = STEP) -> EvalGrid:
    """Evaluations at multiples of the step that see all events: from the step's end in which the first one lies to one
    step after the end of the last one's."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    floor = us - F.pmod(us, F.lit(step_us))
    ends = table(spark, sf_dir, "events").agg(F.min(floor).alias("a"), F.max(floor).alias("b")).first()
    return EvalGrid((ends.a or 0) + step_us, (ends.b or 0) + 2 * step_us, step_us)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespaces of the events, and one that never reports."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("ns")).distinct()
    ns = F.explode(F.when(F.col("ns") == 0, F.array(F.lit("ns-0"), F.lit("ns-9"))).otherwise(
        F.array(F.concat(F.lit("ns-"), F.col("ns").cast("string")))
    ))
    return ids.select(F.lit("web").alias("job"), ns.alias("namespace"))


def shown_rates(rated: DataFrame, *labels: str) -> DataFrame:
    return rated.select(
        "job", "namespace", *[F.col("labels")[c].alias(c) for c in labels],
        F.unix_seconds("eval_ts").alias("eval_sec"), rounded(F.col("rate"), 9).alias("rate"),
    )


def by_time(df: DataFrame, *names: str | Column) -> DataFrame:
    return df.select("job", "namespace", F.unix_seconds("eval_ts").alias("eval_sec"), *names)


@query
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rates.request_rates(event_samples(spark, sf_dir), data_grid(spark, sf_dir), ERROR_WINDOW, extrapolate=False)
    return shown_rates(rated, "pod", "status")


@query
def request_rate_extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rates.request_rates(event_samples(spark, sf_dir), data_grid(spark, sf_dir), ERROR_WINDOW, extrapolate=True)
    return shown_rates(rated, "pod", "status")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error signals with 9 digits, and -1 for null."""
    rated = rates.request_rates(event_samples(spark, sf_dir), data_grid(spark, sf_dir), ERROR_WINDOW, extrapolate=False)
    names = ("total_rps", "rps_5xx", "ratio_5xx")
    return rates.error_signals(rated).withColumns({c: F.coalesce(rounded(F.col(c), 9), F.lit(-1.0)) for c in names})


@query
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_time(errors(spark, sf_dir), "ratio_5xx")


@query
def error_rps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_time(errors(spark, sf_dir), "total_rps", "rps_5xx")


@query
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rates.bucket_rates(event_samples(spark, sf_dir), data_grid(spark, sf_dir), LATENCY_WINDOW, extrapolate=False)
    return by_time(rates.latency_quantile(rated).withColumn("p95", rounded(F.col("p95"))), "p95")


@query
def min_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_time(rates.min_up(event_samples(spark, sf_dir), data_grid(spark, sf_dir), LOOKBACK), "min_up")


@query
def series_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rates.series_present(targets(spark, sf_dir), event_samples(spark, sf_dir), UP_METRIC, data_grid(spark, sf_dir), LOOKBACK)
    return by_time(seen, "present")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.target_signals(
        targets(spark, sf_dir), event_samples(spark, sf_dir), data_grid(spark, sf_dir), ERROR_WINDOW, LATENCY_WINDOW, LOOKBACK, extrapolate=False
    )


def shown_decisions(decided: DataFrame) -> DataFrame:
    """Reason codes and rounded signals: no digits of a text that two engines may print differently."""
    values = [F.coalesce(rounded(F.col(c), 9 if c != "p95" else 6), F.lit(-1.0)).alias(c) for c in rates.SIGNALS]
    return by_time(decided, "should_rollback", F.split_part("reason", F.lit(":"), F.lit(1)).alias("code"), *values)


@query
def rollback_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_decisions(slo.rollback_decision(signals(spark, sf_dir), LIMITS))


def outcomes(rows: DataFrame) -> DataFrame:
    """Every event read as one observation outcome of one of five targets."""
    kind = F.col("event_type")
    return rows.select(
        F.lit("web").alias("job"),
        F.concat(F.lit("ns-"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (kind == "error").alias("should_rollback"),
        F.when(kind == "error", "LATENCY_TOO_HIGH").when(kind.isin("view", "purchase", "signup"), "OBSERVABILITY_PARTIAL")
        .otherwise("OK").alias("reason"),
    )


@query
def observe_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = slo.escalation(outcomes(table(spark, sf_dir, "events")), order=("ts", "event_id"))
    return judged.select("event_id", "namespace", "reason", "consecutive", "severity")


@query
def fleet_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(
        F.lit("web").alias("job"),
        F.concat(F.lit("ns-"), (F.col("user_id") % 16).cast("string")).alias("namespace"),
        F.when(F.col("user_id") % 7 == 6, "").otherwise(F.concat(F.lit("pod-"), (F.col("user_id") % 7).cast("string"))).alias("pod"),
        "ts",
        F.when(F.col("event_type") == "signup", "n/a").otherwise((F.floor("value") % 2).cast("string")).alias("served_version"),
    )
    return slo.fleet_convergence(seen, 1)


# --- serving table ----------------------------------------------------------------------------


def dated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-day features as one version a day, stamped with the end of the day."""
    rows = day_features(spark, sf_dir)
    end_of_day = (F.col("day") + F.lit(1)).cast("timestamp")
    return rows.withColumn(TIME_COL, end_of_day).withColumn(
        "version", F.concat(F.lit("v_"), F.date_format("day", "yyyyMMdd"))
    ).drop("day")


@query
def materialize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a store with one version a day, written in one go; only the versions of the range are read."""
    store = FeatureStore(spark, scratch_path(spark, "day-store"), "activity")
    days = written(dated_features(spark, sf_dir).drop("version"), "dated")
    store.write_windows(days, "daily", sf_dir, parse_contract(CONTRACT, "activity"))
    start, end = "2024-01-05T00:00:00", "2024-01-25T00:00:00"
    rows = materialize.materialize_full(store.read_all(start, end), end, start)
    day = F.to_date(F.from_utc_timestamp(TIME_COL, WALL_CLOCK_OFFSET))
    return shown(rows.withColumn("version", F.concat(F.lit("v_"), F.date_format(F.date_sub(day, 1), "yyyyMMdd"))), "user_id", "version", *FEATURES, TIME_COL)


@query
def materialize_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(dated_features(spark, sf_dir), "dated")
    serving = materialize.ServingTable(spark, scratch_path(spark, "serving"), buckets=16, fold_every=3)
    serving.refresh(rows, "2024-01-15T00:00:00", "2024-01-05T00:00:00")
    for end in ("2024-01-17T00:00:00", "2024-01-18T12:00:00", "2024-01-21T00:00:00", "2024-01-25T00:00:00"):
        serving.advance(rows, end)
    return shown(serving.read(), "user_id", "version", *FEATURES, TIME_COL)


# --- streams ----------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the pattern fits one file and a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query
def stream_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = collected(spark, stream_features(as_events(event_stream(spark, sf_dir))), "stream-features")

    def later(closed: int | None) -> DataFrame:
        week = 7 * 24 * HOUR
        rows = events(spark, sf_dir) if closed is None else events(spark, sf_dir).where(F.unix_micros("event_time") >= closed - week)
        built = stream_features(rows)
        return built if closed is None else built.where(F.unix_micros(TIME_COL) > closed)

    return shown(with_open_windows(stored, later, TIME_COL), "user_id", TIME_COL, *FEATURES)


def minute_scrapes(rows: DataFrame, label: str, value: Column) -> DataFrame:
    """Events, a stream or a table, reduced to one scrape a minute per series: the largest event value."""
    scrapes = (
        rows.select((F.col("user_id") % 3).alias("ns"), value.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
        .withWatermark("ts", "1 hour")
        .groupBy("ns", "kind", F.window("ts", "1 minute").alias("minute"))
        .agg(F.max("value").alias("value"))
    )
    return scrapes.select(
        F.lit("web").alias("job"),
        F.concat(F.lit("ns-"), F.col("ns").cast("string")).alias("namespace"),
        F.create_map(F.lit(label), F.col("kind")).alias("labels"),
        F.window_time("minute").alias("ts"),
        "value",
    )


DAY = 24 * HOUR


def later_day_rates(spark: SparkSession, sf_dir: str, label: str, value: Column, closed: int | None) -> DataFrame:
    """The batch form for days that end after ``closed``, up to the one in which the newest event lies."""
    whole = data_grid(spark, sf_dir, DAY)
    grid = EvalGrid(whole.start_us if closed is None else closed + DAY, whole.end_us - DAY, DAY)
    rows = table(spark, sf_dir, "events")
    if closed is not None:
        rows = rows.where(F.unix_micros(F.col("ts").cast("timestamp")) >= closed)
    if grid.last < 0:
        rows, grid = rows.limit(0), EvalGrid.at(whole.end_us)
    return rates.counter_rates(minute_scrapes(rows, label, value), grid, DAY, extrapolate=False)


def daily_stream_rates(spark: SparkSession, sf_dir: str, label: str, value: Column) -> DataFrame:
    scrapes = minute_scrapes(event_stream(spark, sf_dir), label, value)
    return stream_counter_rates(scrapes, 86_400, 86_400, None, extrapolate=False)


@query
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values scraped by the minute and read as 15 counters, by day."""
    kind = F.col("event_type")
    stored = collected(spark, daily_stream_rates(spark, sf_dir, "kind", kind), "stream-rates")
    rated = with_open_windows(stored, lambda closed: later_day_rates(spark, sf_dir, "kind", kind, closed))
    return shown_rates(rated, "kind").withColumn("rate", rounded(F.col("rate")))


@query
def stream_error_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error ratio of each day, from the same stream read as requests by status."""
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    base = scratch_path(spark, "stream-errors")
    rated = daily_stream_rates(spark, sf_dir, "status", status)
    run_sink(rated, per_batch(rates.error_signals, f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{base}/out").drop("batch")
    signals = with_open_windows(stored, lambda closed: rates.error_signals(later_day_rates(spark, sf_dir, "status", status, closed)))
    names = ("total_rps", "rps_5xx", "ratio_5xx")
    return by_time(signals.withColumns({c: F.coalesce(rounded(F.col(c)), F.lit(-1.0)) for c in names}), *names)


SLICES = 4


def sample_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples that arrive as files, a slice of time after the other and in no order within it: (stream of as many
    micro-batches, the same rows as a table)."""
    rows, path = written(event_samples(spark, sf_dir), "samples"), scratch_path(spark, "sample-files")
    us = F.unix_micros("ts")
    ends = rows.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    width = ((ends.b or 0) - (ends.a or 0)) // SLICES + 1
    for i in range(SLICES):
        rows.where(F.floor((us - (ends.a or 0)) / width) == i).repartition(SLICES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", SLICES).parquet(path), rows


def after(rows: DataFrame, closed: int | None, window_us: int) -> DataFrame:
    """Samples that windows ending after ``closed`` can hold."""
    return rows if closed is None else rows.where(F.unix_micros("ts") > closed - window_us)


def open_grid(grid: EvalGrid, closed: int | None) -> EvalGrid:
    return grid if closed is None else EvalGrid(closed + grid.step_us, max(grid.end_us, closed + grid.step_us), grid.step_us)


@query
def stream_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency quantile of every window as it is closed, over several micro-batches, and of those left open."""
    stream, rows = sample_stream(spark, sf_dir)
    grid, base = data_grid(spark, sf_dir), scratch_path(spark, "stream-p95")
    rated = streamed_rates(stream, {LATENCY_METRIC: LATENCY_WINDOW}, STEP, "1 hour", extrapolate=False).where(F.col("rate").isNotNull())
    run_sink(rated, per_batch(rates.latency_quantile, f"{base}/out"), f"{base}/checkpoint").awaitTermination()

    def later(closed: int | None) -> DataFrame:
        return rates.latency_quantile(rates.bucket_rates(after(rows, closed, LATENCY_WINDOW), open_grid(grid, closed), LATENCY_WINDOW, False))

    p95 = with_open_windows(spark.read.parquet(f"{base}/out").drop("batch"), later)
    return by_time(p95.withColumn("p95", rounded(F.col("p95"))), "p95")


@query
def stream_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollback decisions of every target as windows are closed, over several micro-batches, and for those left open."""
    stream, rows = sample_stream(spark, sf_dir)
    grid, base = data_grid(spark, sf_dir), scratch_path(spark, "stream-rollback")
    windows = {REQUESTS_METRIC: ERROR_WINDOW, LATENCY_METRIC: LATENCY_WINDOW, UP_METRIC: LOOKBACK}
    wanted = written(targets(spark, sf_dir), "targets")
    sink = decision_sink(wanted, f"{base}/data", grid.start_us, STEP, LIMITS)
    run_sink(streamed_rates(stream, windows, STEP, "1 hour", extrapolate=False), sink, f"{base}/checkpoint").awaitTermination()

    def later(closed: int | None) -> DataFrame:
        seen = after(rows, closed, max(windows.values()))
        signals = rates.target_signals(wanted, seen, open_grid(grid, closed), ERROR_WINDOW, LATENCY_WINDOW, LOOKBACK, extrapolate=False)
        return slo.rollback_decision(signals, LIMITS)

    return shown_decisions(with_open_windows(spark.read.parquet(f"{base}/data/out").drop("batch"), later))


@query
def stream_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that arrive in four micro-batches, a third of them a batch late and none in order."""
    rows, path, base = written(outcomes(table(spark, sf_dir, "events")), "outcomes"), scratch_path(spark, "outcome-files"), scratch_path(spark, "stream-escalation")
    us = F.unix_micros("ts")
    ends = rows.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    width = ((ends.b or 0) - (ends.a or 0)) // (SLICES - 1) + 1
    arrives = F.floor((us - (ends.a or 0)) / width) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    for i in range(SLICES):
        rows.where(arrives == i).repartition(SLICES).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", SLICES).parquet(path)
    sink = escalation_sink(f"{base}/data", order=("ts", "event_id"), lateness_sec=2 * width // 1_000_000 + 1)
    run_sink(stream, sink, f"{base}/checkpoint").awaitTermination()
    judged = escalations(spark, f"{base}/data", order=("ts", "event_id"))
    return judged.select("event_id", "namespace", "reason", "consecutive", "severity")
