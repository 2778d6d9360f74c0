"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    return (value is not None, str(type(value)), str(value))


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple(_key(v) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return type(a) is type(b) and a == b


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = normal(found.fetchall(), names)
    have = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    out = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if len(have) != len(want):
        out.append(f"rows {len(have)} != {len(want)}")
    if not want:
        out.append("no rows at all")
    for x, y in zip(have, want):
        if len(x) != len(y) or not all(same(p, q) for p, q in zip(x, y)):
            out.append(f"{x} != {y}")
            if len(out) >= limit:
                break
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            diff = differences(df, con, sql[name]) if name in sql else [] if df.collect() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s", *diff, sep="\n    " if diff else " ", flush=True)
    print("bad:", bad)
