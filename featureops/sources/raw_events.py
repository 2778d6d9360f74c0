"""Raw event CSV: every cell a string, with the number of cells each line really had."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.parse import WHITE_SPACE, first_non_empty, float_or_zero, int_or_zero, wall_clock_to_instant
from ..params import WALL_CLOCK_OFFSET

CELLS_COL = "_cells"
_HEADER_BYTES = 1 << 16  # read at once until the header line is whole
_BAD_LINE = "_corrupt_record"
# All characters that end a line.
_LINE_BREAKS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_QUOTED = '"[^"]*("|$)'  # up to the line's end where the quote is never closed


def read_raw_events(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Columns follow the header; ``_cells`` counts the cells of the line.

    A blank cell and a missing trailing cell both read as null, and only ``_cells`` tells them
    apart, so the CSV reader must parse whole lines (no column pruning). Leave ``multi_line``
    off unless quoted line breaks occur: files then stay splittable.

    All files must have the same header; one that differs, in names or order, raises when it is read.
    Only where the header has unnamed columns are files bound by position.
    """
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    named = not any(c == f"_c{i}" for i, c in enumerate(names))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _BAD_LINE]])
    lines = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnPruning", False)
        .option("enforceSchema", not named)
        .option("columnNameOfCorruptRecord", _BAD_LINE)
        .csv(path)
    )
    counted = F.when(F.col(_BAD_LINE).isNull(), F.lit(len(names))).otherwise(
        F.size(F.split(F.regexp_replace(F.col(_BAD_LINE), _QUOTED, ""), ",", -1))
    )
    return lines.withColumn(CELLS_COL, counted).drop(_BAD_LINE)


def non_blank_lines(text: Column) -> Column:
    """Number of non-blank physical lines inside one text."""
    return F.size(F.filter(F.split(text, _LINE_BREAKS, -1), lambda s: F.btrim(s, F.lit(WHITE_SPACE)) != ""))


def raw_line_check(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines (with the header), and whether there is any data line."""
    counted = spark.read.text(path).agg(
        F.coalesce(F.sum(non_blank_lines(F.col("value"))), F.lit(0)).alias("lines")
    )
    return counted.select("lines", (F.col("lines") > 1).alias("has_data"))


def require_raw_data(spark: SparkSession, path: str) -> int:
    return require_lines(raw_line_check(spark, path).first().lines, path)


def require_lines(lines: int, path: str) -> int:
    if lines <= 1:
        raise ValueError(f"raw source is empty or has only a header: {path}")
    return lines


def _header(path: str) -> str | None:
    """First line of a file that is not blank; None if there is none."""
    local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    files, at = (fs.LocalFileSystem(), os.path.abspath(local)) if "://" not in local else fs.FileSystem.from_uri(local.replace("s3a://", "s3://", 1))
    with files.open_input_stream(at) as stream:
        held = b""
        while True:
            more = stream.read(_HEADER_BYTES)
            held += more
            lines = held.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for line in lines if not more else lines[:-1]:
                if line.strip():
                    return line.removeprefix("\ufeff")
            if not more:
                return None


def header_groups(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every header found under ``path``. Of the files only the first line is read; the driver
    sees one row per header and the names of the files."""
    listed = spark.read.format("binaryFile").load(path).select("path")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"header": [_header(n) for n in names], "path": names}, schema=pa.schema([("header", pa.string()), ("path", pa.string())]))

    found = listed.mapInArrow(headers, "header string, path string").where("header IS NOT NULL")
    groups = found.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("files")).orderBy("header").collect()
    out = []
    for row in groups:
        names: list[str] = []
        for i, name in enumerate(next(csv.reader([row.header]))):
            name = name or f"_c{i}"
            names.append(f"{name}{i}" if name in names else name)
        out.append((names, row.files))
    return out


def parsed_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """Text lines (``value``) as the columns of their header, with ``_cells`` and the ``_lines`` that each one stands for."""
    schema = ", ".join(f"`{n}` STRING" for n in [*names, _BAD_LINE])
    options = {"escape": '"', "columnNameOfCorruptRecord": _BAD_LINE, "mode": "PERMISSIVE"}
    cells = F.from_csv("value", schema, options)
    counted = F.when(F.col("_row")[_BAD_LINE].isNull(), F.lit(len(names))).otherwise(
        F.size(F.split(F.regexp_replace("value", _QUOTED, ""), ",", -1))
    )
    return lines.select(cells.alias("_row"), "value").select(
        *[F.col("_row")[n].alias(n) for n in names], counted.alias(CELLS_COL), non_blank_lines(F.col("value")).alias("_lines")
    )


def read_typed_events(
    spark: SparkSession, path: str, offset: str = WALL_CLOCK_OFFSET, lines: Observation | None = None
) -> DataFrame:
    """(user_id, session_sec, event_time) of all files under ``path``, whose headers may differ: files are grouped by
    header, bound by name, and united. The text is scanned once; ``lines`` observes the number of non-blank lines, headers
    included, as ``lines``. A header line has no usable user and drops out like any other bad row. Quoted line breaks
    need ``read_raw_events``."""
    parts = [_typed(parsed_lines(spark.read.text(files), names), offset, "_lines") for names, files in header_groups(spark, path)]
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
    else:
        rows = spark.createDataFrame([], "user_id bigint, session_sec double, event_time timestamp, _lines int")
    if lines is not None:
        rows = rows.observe(lines, F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"))
    return rows.where(F.col("user_id") != 0).drop("_lines")


def typed_events(raw: DataFrame, offset: str = WALL_CLOCK_OFFSET) -> DataFrame:
    """(user_id, session_sec, event_time) from raw strings; rows without a usable user are dropped.

    ``session_sec`` is null only where the cell does not exist; a blank or bad cell is 0.0 and
    still counts in averages.
    """
    return _typed(raw, offset).where(F.col("user_id") != 0)


def _typed(raw: DataFrame, offset: str, *kept: str) -> DataFrame:
    names = [c for c in raw.columns if c not in (CELLS_COL, *kept)]
    if "user_id" in names:
        user = int_or_zero(F.col("user_id"))
    else:
        user = F.lit(0).cast("bigint")
    if "session_length_sec" in names:
        cell = F.col("session_length_sec")
        if CELLS_COL in raw.columns:
            present = F.col(CELLS_COL) > names.index("session_length_sec")
        else:
            present = cell.isNotNull()
        session = F.when(present, float_or_zero(cell))
    else:
        session = F.lit(None).cast("double")
    texts = [F.col(c) for c in ("event_ts", "timestamp", "ts") if c in names]
    return raw.select(
        user.alias("user_id"),
        session.alias("session_sec"),
        wall_clock_to_instant(first_non_empty(*texts), offset).alias("event_time"),
        *kept,
    )
