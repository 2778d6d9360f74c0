"""Starting the streaming forms over file sources, and storing what they emit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.materialize import ServingTable
from ..session import scratch_path, written
from ..sources.contract import Contract
from ..sources.feature_store import FeatureStore


def store_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append what ``df`` emits to Parquet (exactly once, by the file sink's own log)."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def run_sink(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def collected(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` over all input that is there and read back the stored result."""
    base = scratch_path(spark, name)
    store_stream(df, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def with_open_windows(stored: DataFrame, later: Callable[[int | None], DataFrame], time: str = "eval_ts") -> DataFrame:
    """The final flush: results of a stream that has ended, and those of the windows it left open.

    A window is given out when the watermark passes its end, so the newest ones never are. ``later`` is the batch form
    for windows that end after an instant (epoch microseconds; None if the stream gave out nothing); it needs to
    read only the rows that these windows hold."""
    closed = stored.agg(F.max(F.unix_micros(time))).first()[0]
    return stored.unionByName(later(closed).select(*stored.columns))


def per_batch(transform: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a batch transformation of each micro-batch, in its own folder.

    For windowed input in append mode: a closed window is emitted for all its keys in one
    micro-batch, so sums over series and quantiles over buckets see whole windows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def serving_sink(serving: ServingTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: keeps a serving table, used by this stream only, at the newest row per entity.

    A batch run again after a failure finds its snapshot finished and does nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        serving.merge(batch, batch_id + 1)

    return apply


def version_sink(store: FeatureStore, pipeline: str, source: str, contract: Contract) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: every closed feature window becomes one store version, all of a micro-batch in one write.

    The batch is stored first, as each further use would run the stateful steps again. A batch run again
    after a failure leaves versions already finished as they are.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.write_windows(written(batch, "windows"), pipeline, source, contract)

    return apply
