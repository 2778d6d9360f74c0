"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL_SCRATCH: list[str] = []


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are instants; text and wall clocks are read in UTC everywhere. Streams keep their state in RocksDB,
    off the heap, unless the session names another store."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(STATE_STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="featureops-"))
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once as Parquet in the shared folder and read back: later jobs, and tasks
    rerun after an executor is lost, start from the stored rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def epoch_us(instant: datetime | str | int) -> int:
    """Epoch microseconds of an aware datetime, or of an ISO text (UTC unless it says otherwise)."""
    if isinstance(instant, int):
        return instant
    if isinstance(instant, str):
        instant = datetime.fromisoformat(instant)
        if instant.tzinfo is None:
            instant = instant.replace(tzinfo=timezone.utc)
    if instant.tzinfo is None:
        raise ValueError("naive datetime: give a time zone")
    delta = instant - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def instant_lit(instant: datetime | str | int) -> Column:
    return F.timestamp_micros(F.lit(epoch_us(instant)))
