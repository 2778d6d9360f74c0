"""Versioned feature store on plain folders.

    <base>/<feature_set>/features/version=<v>/   Parquet, written once
    <base>/<feature_set>/csv/version=<v>/        optional CSV copy
    <base>/<feature_set>/contracts/version=<v>/  contract document
    <base>/<feature_set>/profiles/version=<v>/   value buckets of the numeric columns, for the next drift gate
    <base>/<feature_set>/versions/               one lineage row appended per finished version, with its time range
    <base>/<feature_set>/published/              one row appended per publication

Nothing a reader may be scanning is ever overwritten: a version counts once its lineage row
exists, and ``latest`` is the newest publication row, appended only after the drift gate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..operators.drift import PROFILE_SCHEMA, drift_profile
from ..params import ENTITY_COL, TIME_COL, WALL_CLOCK_OFFSET
from ..session import epoch_us, instant_lit
from .contract import Contract

VERSION_SCHEMA = (
    "version string, generated_at timestamp, source string, pipeline string, schema_hash string, "
    "feature_uri string, feature_set string, min_event_time timestamp, max_event_time timestamp"
)
SPREAD = 8  # tasks that write a window's rows
PUBLISHED_SCHEMA = "version string, published_at timestamp"


class VersionExists(ValueError):
    """The version is finished and will not be written again."""


def version_id(run_time: Column) -> Column:
    """``v_`` and the wall-clock second of the run."""
    wall = F.from_utc_timestamp(run_time, WALL_CLOCK_OFFSET)
    return F.concat(F.lit("v_"), F.date_format(wall, "yyyyMMdd'T'HHmmss"))


def with_utc_event_time(df: DataFrame, run_time: datetime | str | int) -> DataFrame:
    """``event_timestamp`` as a timestamp: stamped when absent; a bad text raises."""
    if TIME_COL not in df.columns:
        return df.withColumn(TIME_COL, instant_lit(run_time))
    return df.withColumn(TIME_COL, F.col(TIME_COL).cast("timestamp"))


@dataclass(frozen=True)
class FeatureStore:
    spark: SparkSession
    base: str
    feature_set: str

    def _path(self, part: str, version: str | None = None) -> str:
        root = f"{self.base.rstrip('/')}/{self.feature_set}/{part}"
        return f"{root}/version={version}" if version else root

    def _table(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(self._path(part))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        return self._table("versions", VERSION_SCHEMA)

    def published(self) -> DataFrame:
        return self._table("published", PUBLISHED_SCHEMA)

    def feature_uri(self, version: str) -> str:
        return self._path("features", version)

    def write(
        self,
        features: DataFrame,
        run_time: datetime | str | int,
        pipeline: str,
        source: str,
        contract: Contract,
        csv_copy: bool = False,
        check: Callable[[], object] | None = None,
    ) -> str:
        """Write one version and return its id. A finished version cannot be written again.

        ``check`` runs when the rows are stored; if it raises, the version stays unfinished, so that nobody sees it.
        """
        one = self.spark.range(1)
        version = one.select(version_id(instant_lit(run_time)).alias("v")).first().v
        if not self.versions().where(F.col("version") == version).isEmpty():
            raise VersionExists(version)
        uri = self.feature_uri(version)
        with_utc_event_time(features, run_time).write.mode("overwrite").parquet(uri)
        if check is not None:
            check()
        if csv_copy:
            stored = self.spark.read.parquet(uri)
            stored.write.mode("overwrite").option("header", True).csv(self._path("csv", version))
        drift_profile(self.read(version)).coalesce(1).write.mode("overwrite").parquet(self._path("profiles", version))
        self._finish(one.select(F.lit(version).alias("version"), instant_lit(run_time).alias("generated_at")), pipeline, source, contract)
        return version

    def _finish(self, done: DataFrame, pipeline: str, source: str, contract: Contract) -> None:
        """Contract documents and lineage rows of the stored versions in ``done`` (version, generated_at). The time
        range of a version is read from its stored rows."""
        done.select("version", F.lit(contract.document).alias("value")).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("version").text(self._path("contracts"))
        names = [r.version for r in done.collect()]
        ranges = self._features(names).groupBy("version").agg(
            F.min(TIME_COL).alias("min_event_time"), F.max(TIME_COL).alias("max_event_time")
        )
        lineage = done.join(ranges, "version", "left").select(
            "version",
            "generated_at",
            F.lit(source).alias("source"),
            F.lit(pipeline).alias("pipeline"),
            F.lit(contract.fingerprint).alias("schema_hash"),
            F.concat(F.lit(self._path("features") + "/version="), "version").alias("feature_uri"),
            F.lit(self.feature_set).alias("feature_set"),
            "min_event_time",
            "max_event_time",
        )
        lineage.coalesce(1).write.mode("append").json(self._path("versions"))

    def write_windows(self, features: DataFrame, pipeline: str, source: str, contract: Contract) -> list[str]:
        """One version per event time of ``features``, a stored table, in a single write partitioned by version; returns
        the new ids. Finished versions are left as they are; leftovers of an unfinished run are replaced."""
        rows = features.withColumn("version", version_id(F.col(TIME_COL)))
        ends = rows.groupBy("version").agg(F.max(TIME_COL).alias("generated_at"))
        new = ends.join(self.versions().select("version").distinct(), "version", "left_anti").sort("version").collect()
        if not new:
            return []
        names = [r.version for r in new]
        dealt = rows.where(F.col("version").isin(names)).repartition("version", F.pmod(F.xxhash64(ENTITY_COL), F.lit(SPREAD)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(self._path("features"))
        self._finish(self.spark.createDataFrame(new), pipeline, source, contract)
        return names

    def publish(self, version: str, published_at: datetime | str | int) -> None:
        self.spark.range(1).select(
            F.lit(version).alias("version"), instant_lit(published_at).alias("published_at")
        ).write.mode("append").json(self._path("published"))

    def latest(self) -> str | None:
        return self.published().agg(F.max_by("version", F.struct("published_at", "version")).alias("v")).first().v

    def previous(self, version: str) -> str | None:
        """The newest published version before this one; version ids sort by time."""
        older = self.published().where(F.col("version") < version)
        return older.agg(F.max("version").alias("v")).first().v

    def profile(self, version: str) -> DataFrame | None:
        """Value buckets of the version's numeric columns, for the drift gate of the next one; None if it has none."""
        try:
            return self.spark.read.schema(PROFILE_SCHEMA).parquet(self._path("profiles", version))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, version: str) -> DataFrame:
        return self.spark.read.parquet(self.feature_uri(version))

    def _features(self, versions: list[str]) -> DataFrame:
        reader = self.spark.read.option("basePath", self._path("features")).option("mergeSchema", True)
        return reader.parquet(*[self._path("features", v) for v in versions])

    def read_all(self, start: datetime | str | int | None = None, end: datetime | str | int | None = None) -> DataFrame:
        """Every finished version, with its ``version`` column; with ``start`` or ``end`` only those that have event times
        between them (both included): other folders are not even listed.

        Columns are the union over the versions, null where a version has none; a column whose type changed raises.
        """
        wanted = self.versions()
        low, high = F.unix_micros("min_event_time"), F.unix_micros("max_event_time")
        if start is not None:
            wanted = wanted.where(high.isNull() | (high >= epoch_us(start)))
        if end is not None:
            wanted = wanted.where(low.isNull() | (low <= epoch_us(end)))
        names = sorted(r[0] for r in wanted.select("version").distinct().collect())
        if names:
            return self._features(names)
        every = [r[0] for r in self.versions().select("version").distinct().collect()]
        return self._features(every).limit(0)

    def run_summary(self, pipeline: str) -> DataFrame:
        return (
            self.versions()
            .where(F.col("pipeline") == pipeline)
            .select("pipeline", F.col("source").alias("raw_path"), "version", "feature_uri", "feature_set")
        )
