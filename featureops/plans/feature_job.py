"""Raw events to a published feature version: check, build, store, compare, train, decide."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.drift import drift_gate
from ..operators.features import align_to_contract, batch_quality, entity_features
from ..operators.promotion import promotion_decision
from ..operators.training import TrainResult, save_model, train
from ..params import ENTITY_COL, DriftLimits, LabelRule, QualityLimits, RunSource, TrainLimits
from ..session import configure
from ..sources.contract import Contract
from ..sources.feature_store import FeatureStore
from ..sources.raw_events import read_typed_events, require_lines


@dataclass
class BuildResult:
    version: str
    lines: int
    quality: DataFrame


def build_version(
    spark: SparkSession,
    raw_path: str,
    store: FeatureStore,
    contract: Contract,
    run_time: datetime | str | int,
    pipeline: str,
    rule: LabelRule = LabelRule(),
    quality: QualityLimits = QualityLimits(),
    csv_copy: bool = False,
) -> BuildResult:
    """Writes one version, from one scan of the raw text. The quality row is computed from the stored rows, not by a second build."""
    configure(spark)
    lines = Observation("raw")
    features = entity_features(read_typed_events(spark, raw_path, lines=lines), run_time, rule=rule)
    aligned = align_to_contract(features, contract.columns)
    # counted while the rows are built and stored; a source without data gives no version
    version = store.write(aligned, run_time, pipeline, raw_path, contract, csv_copy, lambda: require_lines(lines.get["lines"], raw_path))
    return BuildResult(version, lines.get["lines"], batch_quality(store.read(version), quality))


def gate_version(store: FeatureStore, version: str, limits: DriftLimits = DriftLimits()) -> DataFrame:
    """Compare a version with the newest published one before it: a blocked batch is no baseline."""
    previous = store.previous(version)
    ref, profile = (store.read(previous), store.profile(previous)) if previous else (None, None)
    return drift_gate(store.read(version), ref, [ENTITY_COL], store.spark, limits, profile=profile)


@dataclass
class ReleaseResult:
    drift: DataFrame
    training: TrainResult
    decision: DataFrame


def release_version(
    store: FeatureStore,
    version: str,
    run_time: datetime | str | int,
    runs_path: str,
    model_path: str,
    env: str | None = None,
    code_version: str | None = None,
    schema_hash: str | None = None,
    drift: DriftLimits = DriftLimits(),
    limits: TrainLimits = TrainLimits(),
) -> ReleaseResult:
    """Gate, train, record the run, decide, and publish the version if it is promoted.

    A model goes to a folder of its run, ``<model_path>/run=<run_id>``; no run overwrites another's. The decision
    carries the gate's reason."""
    spark = configure(store.spark)
    uri = store.feature_uri(version)
    gate = gate_version(store, version, drift).first()
    source = RunSource(uri, version, schema_hash, env, code_version)
    result = train(store.read(version), [ENTITY_COL], source, run_time, limits)
    result.run.write.mode("append").json(runs_path)
    if result.model is not None:
        save_model(spark, result.model, f"{model_path.rstrip('/')}/run={result.run_id}")
    decision = promotion_decision(
        result.run.select("run_id", F.col("accuracy").cast("string").alias("accuracy")).withColumn(
            "drift_block", F.lit(str(gate.block_promotion))
        ),
        limits.accuracy_threshold,
    ).withColumn("drift_reason", F.lit(gate.reason))
    if decision.first().decision == "promote":
        store.publish(version, run_time)
    gate_row = spark.createDataFrame([gate], "block_promotion boolean, reason string, worst_col string, "
                                     "worst_ks double, worst_p double, signals map<string,double>")
    return ReleaseResult(gate_row, result, decision)
