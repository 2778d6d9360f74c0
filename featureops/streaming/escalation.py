"""Escalation counter kept up to date by micro-batches of observation outcomes, in any order.

A late outcome changes the counts of the outcomes after it. So the rows of a target that are younger than its newest
one by at most ``lateness_sec`` are kept, with the count that was given out for each, and the run that they
start with. A micro-batch judges the kept and the new rows of its targets together: new rows and those whose count
has changed are given out as the next revision, so that what was said before is taken back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.slo import escalation
from ..params import RollbackLimits


def escalation_sink(
    path: str,
    target: Sequence[str] = ("job", "namespace"),
    order: Sequence[str] = ("ts",),
    chunk_sec: int = 60,
    after: int = RollbackLimits.escalate_after,
    lateness_sec: int = 3_600,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. Writes, per micro-batch:

        <path>/out/batch=<id>    new and changed rows; ``escalations`` gives the newest revision of each
        <path>/late/batch=<id>   rows older than what is kept of their target: not counted, but not lost silently
        <path>/tail, <path>/base the kept rows, and each target's newest row before them with its run

    Batch n reads the state of batch n-1 and overwrites its own folders, so a batch that is run again after a
    failure gives the same result. Inside a batch the work is the distributed batch operator: a busy target is split
    by time, not looped over in one task. ``order`` columns are unique per target, the first one is a timestamp.
    """
    keys, place = list(target), F.struct(*order)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def part(name: str, at: int = batch_id) -> str:
            return f"{path}/{name}/batch={at}"

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(part(name))
            return spark.read.schema(df.schema).parquet(part(name))

        columns = batch.columns
        tail = base = None
        usable = batch
        if batch_id > 0:
            tail, base = (spark.read.parquet(part(n, batch_id - 1)) for n in ("tail", "base"))
            placed = batch.join(base.select(*keys, F.col("newest").alias("_newest")), keys, "left")
            too_late = F.coalesce(place <= F.col("_newest"), F.lit(False))
            stored(placed.where(too_late).select(*columns), "late")
            usable = placed.where(~too_late).select(*columns)
        rows = usable.withColumn("_said", F.lit(None).cast("bigint"))
        if tail is not None:
            touched = usable.select(*keys).distinct()
            kept = tail.join(touched, keys, "left_semi")
            rows = rows.unionByName(kept.select(*columns, F.col("consecutive").alias("_said")))
        judged = stored(escalation(rows, target, order, chunk_sec, after, base), "judged")
        changed = F.col("_said").isNull() | (F.col("_said") != F.col("consecutive"))
        stored(judged.where(changed).drop("_said"), "out")

        now = judged.drop("_said")
        if tail is not None:
            now = now.unionByName(tail.join(touched, keys, "left_anti"))
        edge = now.groupBy(*keys).agg((F.max(F.unix_micros(order[0])) - lateness_sec * 1_000_000).alias("_edge"))
        aged = now.join(edge, keys).withColumn("_old", F.unix_micros(order[0]) < F.col("_edge"))
        stored(aged.where(~F.col("_old")).drop("_edge", "_old"), "tail")
        ends = aged.where("_old").select(*keys, place.alias("newest"), "consecutive")
        if base is not None:
            ends = ends.unionByName(base)
        stored(ends.groupBy(*keys).agg(F.max("newest").alias("newest"), F.max_by("consecutive", "newest").alias("consecutive")), "base")

    return apply


def escalations(spark: SparkSession, path: str, target: Sequence[str] = ("job", "namespace"), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest revision of every row that the sink has given out."""
    said = spark.read.parquet(f"{path}/out")
    keys = [*target, *order]
    rest = [c for c in said.columns if c not in (*keys, "batch")]
    newest = said.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in said.columns if c != "batch"])
