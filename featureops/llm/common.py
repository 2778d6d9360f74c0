"""What the operators of this package share: reading, scanning in Arrow batches, storing, joining components.

Every operator reads only the columns it names, so extra columns of any name are harmless. A null text
counts as the empty text. A row is kept for each input row unless an operator's docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from featureops.session import written

__all__ = ["table", "texts", "remainder", "scan", "written", "components", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(mod: int) -> Column:
    """crc32 of the doc_id as decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def words(text: str) -> list[bytes]:
    """Runs between ASCII white space, with A-Z lowered, as UTF-8."""
    return text.encode().lower().split()


def scan(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict[str, Any]]]], schema: str) -> DataFrame:
    """Arrow batches through Python. ``make()`` runs once per task and returns what turns a batch into
    column dictionaries; a last call with None lets it give out what it still holds."""
    # Workers on machines that have the package at the same place find it there.
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    shape = StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        for out in step(None):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, shape)


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest member (``root``) of each connected component, per ``node``, for undirected edges.

    Alternates linking larger neighbours to the smallest one known (large star) and smaller ones among
    themselves (small star). Rounds are stored in the shared folder; their number grows with the
    logarithm of the longest chain, and a hub's edges are only ever aggregated, never collected.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = written(edges.where(F.col(a) != F.col(b)).select(low.alias("u"), high.alias("v")).distinct(), f"{name}-edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        after = written(small.distinct(), f"{name}-edges")
        heads = after.select("u").distinct().join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        several = after.groupBy("v").count().where("count > 1")
        now = after
        if heads.isEmpty() and several.isEmpty():
            break
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
