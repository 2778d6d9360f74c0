"""Serving table: the newest feature row per entity, as a full refresh or incrementally.

    <path>/base/snapshot=<n>/serving_bucket=<b>/    one row per entity of the bucket
    <path>/delta/snapshot=<n>/serving_bucket=<b>/   newest rows of an increment, touched buckets only
    <path>/manifest/snapshot=<n>/                   per bucket: its base and the deltas since
    <path>/marks/                                   one row appended per finished snapshot

Entities are dealt to buckets by hash. An increment writes a delta for the buckets it touches; a bucket with
``fold_every`` deltas is folded into a new base, and no other bucket is read or written. Readers merge a bucket's base
with its few deltas. Files are written once: the newest mark names the current snapshot, so a half-written one is
never seen, and a job that runs again overwrites its own folders only.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..params import ENTITY_COL, FULL_REFRESH_START, TIME_COL
from ..session import epoch_us, instant_lit

BUCKET = "serving_bucket"
MARK_SCHEMA = "snapshot bigint, end_time timestamp, buckets int"
MANIFEST_SCHEMA = f"{BUCKET} int, base bigint, deltas array<bigint>"


def latest_per_entity(features: DataFrame, entity: str = ENTITY_COL) -> DataFrame:
    """Newest row per entity by (event time, version); what is left of a tie goes to the largest row.

    A maximum is merged inside each task before the shuffle, so an entity with very many rows
    does not end up in one task.
    """
    order = [c for c in (TIME_COL, "version") if c in features.columns]
    others = [c for c in features.columns if c not in (entity, *order)]
    newest = features.groupBy(entity).agg(F.max(F.struct(*order, *others)).alias("_row"))
    return newest.select(*[F.col(c) if c == entity else F.col("_row")[c].alias(c) for c in features.columns])


def materialize_full(
    features: DataFrame, end: datetime | str | int, start: datetime | str | int = FULL_REFRESH_START
) -> DataFrame:
    """Latest row per entity with event time in [start, end]."""
    t = F.col(TIME_COL)
    return latest_per_entity(features.where((t >= instant_lit(start)) & (t <= instant_lit(end))))


def materialize_incremental(
    current: DataFrame, features: DataFrame, mark: datetime | str | int, end: datetime | str | int
) -> DataFrame:
    """``current`` brought up to date with rows whose event time is in (mark, end]."""
    t = F.col(TIME_COL)
    fresh = latest_per_entity(features.where((t > instant_lit(mark)) & (t <= instant_lit(end))))
    return latest_per_entity(current.unionByName(fresh))


@dataclass(frozen=True)
class ServingTable:
    spark: SparkSession
    path: str
    buckets: int = 64  # of a new table; one that exists keeps its own
    fold_every: int = 8
    entity: str = ENTITY_COL

    def _mark(self) -> Row | None:
        try:
            marks = self.spark.read.schema(MARK_SCHEMA).json(f"{self.path}/marks")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return marks.agg(F.max(F.struct("snapshot", F.unix_micros("end_time").alias("us"), "buckets")).alias("m")).first().m

    def manifest(self, snapshot: int) -> dict[int, tuple[int | None, list[int]]]:
        """Base and deltas of each bucket that has rows: as many entries as there are buckets."""
        rows = self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.path}/manifest/snapshot={snapshot}").collect()
        return {r[BUCKET]: (r.base, list(r.deltas)) for r in rows}

    def _write(self, rows: DataFrame, part: str, snapshot: int, buckets: int) -> list[int]:
        """Store rows by bucket; returns the buckets that have any."""
        folder = f"{self.path}/{part}/snapshot={snapshot}"
        bucket = F.pmod(F.xxhash64(self.entity), F.lit(buckets)).cast("int")
        dealt = rows.withColumn(BUCKET, bucket).repartition(buckets, BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        stored = self.spark.read.schema(StructType([StructField(BUCKET, IntegerType())])).parquet(folder)
        return sorted(r[0] for r in stored.select(BUCKET).distinct().collect())

    def _publish(self, snapshot: int, end_us: int, buckets: int, manifest: dict[int, tuple[int | None, list[int]]]) -> None:
        rows = [(b, base, deltas) for b, (base, deltas) in sorted(manifest.items())]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/snapshot={snapshot}")
        self.spark.range(1).select(
            F.lit(snapshot).alias("snapshot"), instant_lit(end_us).alias("end_time"), F.lit(buckets).alias("buckets")
        ).write.mode("append").json(f"{self.path}/marks")

    def _stored(self, part: str, files: list[tuple[int, int]]) -> DataFrame:
        folder = f"{self.path}/{part}"
        reader = self.spark.read.option("basePath", folder).option("mergeSchema", True)
        paths = [f"{folder}/snapshot={s}/{BUCKET}={b}" for s, b in files]
        return reader.parquet(*paths).drop("snapshot", BUCKET)

    def _rows(self, manifest: dict[int, tuple[int | None, list[int]]]) -> DataFrame | None:
        """Current rows of these buckets; those without deltas are only read."""
        parts = []
        whole = [(base, b) for b, (base, deltas) in manifest.items() if base is not None and not deltas]
        if whole:
            parts.append(self._stored("base", whole))
        merged = {b: m for b, m in manifest.items() if m[1]}
        if merged:
            rows = self._stored("delta", [(d, b) for b, (_, deltas) in merged.items() for d in deltas])
            bases = [(base, b) for b, (base, _) in merged.items() if base is not None]
            if bases:
                rows = self._stored("base", bases).unionByName(rows, allowMissingColumns=True)
            parts.append(latest_per_entity(rows, self.entity))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None

    def read(self) -> DataFrame:
        mark = self._mark()
        if mark is None:
            raise ValueError(f"{self.path} has no finished snapshot")
        rows = self._rows(self.manifest(mark.snapshot))
        if rows is not None:
            return rows
        # a snapshot without rows still has the columns of its increment
        return self.spark.read.parquet(f"{self.path}/empty").limit(0)

    def refresh(self, features: DataFrame, end: datetime | str | int, start: datetime | str | int = FULL_REFRESH_START) -> DataFrame:
        """The whole table anew, every bucket with a base of its own."""
        mark = self._mark()
        snapshot, buckets = (mark.snapshot + 1, mark.buckets) if mark else (1, self.buckets)
        filled = self._write(materialize_full(features, end, start), "base", snapshot, buckets)
        return self._finish(features, snapshot, epoch_us(end), buckets, {b: (snapshot, []) for b in filled})

    def _finish(self, features: DataFrame, snapshot: int, end_us: int, buckets: int, manifest: dict) -> DataFrame:
        if not manifest:
            features.limit(0).write.mode("overwrite").parquet(f"{self.path}/empty")
        self._publish(snapshot, end_us, buckets, manifest)
        return self.read()

    def _increment(self, fresh: DataFrame, snapshot: int, end_us: int, mark: Row | None) -> DataFrame:
        """A delta of the newest rows, and new bases for the buckets that have enough deltas by now."""
        buckets = mark.buckets if mark else self.buckets
        manifest = self.manifest(mark.snapshot) if mark else {}
        for b in self._write(fresh, "delta", snapshot, buckets):
            base, deltas = manifest.get(b, (None, []))
            manifest[b] = base, [*deltas, snapshot]
        full = {b: m for b, m in manifest.items() if len(m[1]) >= self.fold_every}
        if full:
            self._write(self._rows(full), "base", snapshot, buckets)
            manifest |= {b: (snapshot, []) for b in full}
        return self._finish(fresh, snapshot, end_us, buckets, manifest)

    def merge(self, rows: DataFrame, snapshot: int) -> None:
        """Bring the table up to ``snapshot`` with new rows in any order; a finished snapshot stays. The mark moves to
        the newest event time, so that a later ``advance`` reads on from there."""
        mark = self._mark()
        if mark is not None and mark.snapshot >= snapshot:
            return
        fresh = latest_per_entity(rows, self.entity)
        newest = rows.agg(F.max(F.unix_micros(TIME_COL))).first()[0]
        ends = [x for x in (newest, mark.us if mark else None) if x is not None]
        self._increment(fresh, snapshot, max(ends, default=0), mark)

    def advance(self, features: DataFrame, end: datetime | str | int) -> DataFrame:
        """Only rows after the last mark are read; without a mark this is a full refresh."""
        mark = self._mark()
        if mark is None:
            return self.refresh(features, end)
        t = F.col(TIME_COL)
        fresh = latest_per_entity(features.where((t > instant_lit(mark.us)) & (t <= instant_lit(end))), self.entity)
        return self._increment(fresh, mark.snapshot + 1, epoch_us(end), mark)
