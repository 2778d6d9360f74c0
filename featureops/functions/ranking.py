"""Exact selection by a pseudo-random but repeatable row order.

Rows are ordered by the MD5 of their key and a seed, so a selection does not depend on
partitioning and can be repeated in any engine. No step sorts a whole table or a whole
class in one task: counts per hash prefix, from one scan, find the prefix in which the cut
lies, and only rows of that prefix are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PREFIX_DIGITS = 4  # 65,536 prefixes: one row in as many is left for the last ranking


def order_hash(key_cols: Sequence[str], seed: int) -> Column:
    """32 hex digits; ``key_cols`` must identify a row. Each part is written with its length, a null as a mark of its
    own, so that no two keys are hashed alike."""
    texts = [F.col(c).cast("string") for c in key_cols] + [F.lit(str(seed))]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def exact_sample(df: DataFrame, n: int, key_cols: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows if there are no more than ``n``.

    One narrow pass counts rows by the bit length of a 60-bit hash (at most 61 groups). The
    smallest bit length that covers ``n`` rows keeps about ``n`` to ``2n`` rows, which is what
    the final top-n has to handle, whatever the table size.
    """
    h = order_hash(key_cols, seed)
    bits = F.length(F.bin(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")))
    per_bits = df.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("cnt"))
    covered = per_bits.withColumn("upto", F.sum("cnt").over(Window.orderBy("bits")))
    cut = covered.agg(
        F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("bits"))), F.lit(60)).alias("cut")
    )
    return (
        df.where(bits <= cut.scalar())
        .withColumn("_order", h)
        .orderBy("_order", *key_cols)
        .limit(n)
        .drop("_order")
    )


def prefix_counts(df: DataFrame, group: str, key_cols: Sequence[str], seed: int) -> DataFrame:
    """(group, _prefix, _cnt): rows per group and hash prefix, in one scan. Class sizes, quotas and the prefixes in which
    cuts lie all follow from it."""
    prefix = F.substring(order_hash(key_cols, seed), 1, PREFIX_DIGITS).alias("_prefix")
    return df.groupBy(group, prefix).agg(F.count("*").alias("_cnt"))


def hash_cuts(df: DataFrame, counts: DataFrame, quotas: DataFrame, group: str, key_cols: Sequence[str], seed: int) -> DataFrame:
    """(group, _cut): the hash of rank ``quota`` in every group with ``quota`` >= 1. A null is a group like any other.

    ``quotas`` has one row per group: (group, quota). The prefix of a cut is read off the counts; only its rows are
    ranked, in a second scan of ``df``."""
    wanted = quotas.where(F.col("quota") >= 1).select(F.col(group).alias("_group"), F.col("quota").alias("_need"))
    running = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_cnt").over(running))
    cut = upto.join(wanted, F.col(group).eqNullSafe(F.col("_group"))).where(
        (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_cnt") < F.col("_need"))
    ).select("_group", F.col("_prefix").alias("_at"), (F.col("_need") - (F.col("_upto") - F.col("_cnt"))).alias("_rest"))
    hashed = df.select(F.col(group), order_hash(key_cols, seed).alias("_order"))
    near = hashed.join(cut, F.col(group).eqNullSafe(F.col("_group")) & (F.substring("_order", 1, PREFIX_DIGITS) == F.col("_at")))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_order")))
    return ranked.where(F.col("_rank") == F.col("_rest")).select(group, F.col("_order").alias("_cut"))
