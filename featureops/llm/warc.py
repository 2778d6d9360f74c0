"""WARC archives of pages: a deterministic sharded writer and a reader that checks what it reads.

Every page is one record, a gzip member of its own. Records are range-sorted by page_id and payload; the running
sum of their compressed sizes says which file each goes to, so that files and their bytes depend on the rows
alone, not on how they were dealt to tasks. Of records with equal payloads (SHA-256 and length) the smallest
page_id is written as response and the others as revisits that name it. Record ids, lengths, block and payload
digests are made anew from the rows.

Each attempt of a task writes under a temporary name of its own. The names of the attempts that Spark committed
form a manifest; only these files are then moved to their final names, which may be repeated, and the reader
opens nothing that the final manifest doesn't list. So a lost executor leaves no half-written archive.

A null html is an empty payload, a null url the target ``urn:page``; bytes that a header can't hold are percent-encoded. Rows
without page_id come first and may be the response of a group whose ids are all null. Repeated rows are records of
their own: one response, the rest revisits. An empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from featureops.llm.common import scan, table, written
from featureops.session import scratch_path

FILE_BYTES = 32 << 20  # compressed; a file is closed by the record that reaches it
LEAST_REVISIT = 0  # payload bytes; equal payloads below are all written whole
DATE = "2024-01-01T00:00:00Z"
SALTS = 16  # parts of a group of equal payloads
BLOCK = 1 << 20  # bytes read at once
LINE = "\r\n"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_text(value: str) -> str:
    """White space, control signs and what lies outside ASCII, percent-encoded: a value of one line."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in value.encode())


def record_id(page_id: int | None, payload_sha256: bytes, ordinal: int) -> str:
    seed = hashlib.sha256(b"%s|%s|%d" % (str(page_id).encode(), payload_sha256, ordinal)).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def member(fields: list[tuple[str, Any]], block: bytes) -> bytes:
    """One record, compressed; fields without a value are left out."""
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    head = LINE.join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes, key: bytes,
                ordinal: int, refers: str | None, refers_page: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP header of the response only."""
    http = LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]).encode()
    block = http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, key, ordinal)),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_text(url) if url else "urn:page"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To", refers),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_page),
    ]
    return member(fields, block)


def info_record(name: str, date: str) -> bytes:
    block = f"format: WARC File Format 1.1{LINE}".encode()
    made = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)
    return member(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{made}>"), ("WARC-Date", date), ("WARC-Filename", name),
         ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/warc-fields")], block)


# --- writing ----------------------------------------------------------------------------------


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Each page as a compressed response, with the digests of its payload."""
    names = ("page_id", "url", "payload_key", "length", "digest", "salt", "gz")

    def make() -> Any:
        counter = itertools.count()

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            out: dict[str, list] = {n: [] for n in names}
            for page_id, url, html in zip(*batch.columns) if batch is not None else ():
                page_id, url, payload = page_id.as_py(), url.as_py(), html.as_py().encode()
                key, digest = hashlib.sha256(payload).digest(), sha1(payload)
                gz = page_record("response", page_id, url, digest, len(payload), payload, key, 0, None, None, date)
                for n, value in zip(names, (page_id, url, key, len(payload), digest, next(counter) % SALTS, gz)):
                    out[n].append(value)
            yield out

        return step

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return scan(rows, make, "page_id long, url string, payload_key binary, length long, digest string, salt int, gz binary")


def copied_payloads(pages: DataFrame, least_revisit: int) -> DataFrame:
    """(payload_key, length, first_id) of payloads that several rows have, once for each salt."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.unhex(F.sha2(payload, 256)).alias("payload_key"),
        F.octet_length(payload).cast("long").alias("length"),
    )
    groups = keyed.where(F.col("length") >= least_revisit).groupBy("payload_key", "length").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return groups.where("n > 1").select("payload_key", "length", "first_id", F.lit(True).alias("copied"), salts)


def placed(rows: DataFrame, date: str) -> DataFrame:
    """Final records in sorted order: (part, at, size, gz), ``at`` being the compressed bytes before it in its part."""
    names = ("part", "at", "size", "gz")

    def make() -> Any:
        part, at, last, ordinal = TaskContext.get().partitionId(), 0, None, 0

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            nonlocal at, last, ordinal
            out: dict[str, list] = {n: [] for n in names}
            for page_id, url, key, length, digest, first_id, copied, gz in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else ():
                ordinal = ordinal + 1 if last == (page_id, key) else 0
                last = page_id, key
                if copied and (ordinal or page_id != first_id):
                    refers = record_id(first_id, key, 0)
                    gz = page_record("revisit", page_id, url, digest, length, b"", key, ordinal, refers, first_id, date)
                elif ordinal:  # a repeated row that is written whole needs an id of its own
                    payload = parsed(gzip.decompress(gz))[1].split(b"\r\n\r\n", 1)[1]
                    gz = page_record("response", page_id, url, digest, length, payload, key, ordinal, None, None, date)
                for n, value in zip(names, (part, at, len(gz), gz)):
                    out[n].append(value)
                at += len(gz)
            yield out

        return step

    order = [F.col("page_id").asc_nulls_first(), F.col("payload_key")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("url").asc_nulls_first())
    columns = ("page_id", "url", "payload_key", "length", "digest", "first_id", "copied", "gz")
    return scan(ranged.select(*columns), make, "part int, at long, size long, gz binary")


def temporary_files(records: DataFrame, count: int, folder: str, date: str) -> DataFrame:
    """Writes the records of each of ``count`` files, in order, under a name of this attempt; a manifest row per file."""
    names = ("name", "temporary", "records", "bytes", "sha256")

    def make() -> Any:
        files, root = filesystem(folder)
        attempt = uuid.uuid4().hex
        now: dict[str, Any] = {}

        def put(data: bytes) -> None:
            now["stream"].write(data)
            now["digest"].update(data)
            now["bytes"] += len(data)

        def close() -> tuple:
            now["stream"].close()
            row = now["name"], now["temporary"], now["records"], now["bytes"], now["digest"].hexdigest()
            now.clear()
            return row

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            done = []
            for file, gz in zip(*batch.columns) if batch is not None else ():
                name = f"pages-{file.as_py():08d}.warc.gz"
                if now and now["name"] != name:
                    done.append(close())
                if not now:
                    temporary = f"{root}/_temporary/{name}.{attempt}"
                    now.update(name=name, temporary=temporary, records=0, bytes=0, digest=hashlib.sha256(), stream=files.open_output_stream(temporary, compression=None))
                    put(info_record(name, date))
                put(gz.as_py())
                now["records"] += 1
            if batch is None and now:
                done.append(close())
            yield {n: [r[i] for r in done] for i, n in enumerate(names)}

        return step

    # one file a task: hashed numbers would now and then meet in one
    ordered = records.repartitionById(count, F.col("file").cast("int")).sortWithinPartitions("file", "part", "at").select("file", "gz")
    return scan(ordered, make, "name string, temporary string, records long, bytes long, sha256 string")


def committed(manifest: DataFrame, folder: str) -> DataFrame:
    """Moves the files of the manifest to their final names. A file that is there already was moved by an earlier attempt."""

    def make() -> Any:
        files, root = filesystem(folder)

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            rows = batch.to_pylist() if batch is not None else []
            for r in rows:
                final = f"{root}/{r['name']}"
                if files.get_file_info(r["temporary"]).type == fs.FileType.File:
                    files.move(r["temporary"], final)
                there = files.get_file_info(final)
                if there.size != r["bytes"]:
                    raise OSError(f"{final}: {there.size} bytes, not {r['bytes']}")
            yield {n: [r[n] for r in rows] for n in ("name", "records", "bytes", "sha256")}

        return step

    return scan(manifest, make, "name string, records long, bytes long, sha256 string")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least_revisit: int = LEAST_REVISIT, date: str = DATE) -> DataFrame:
    """Archives of all pages in ``folder``, a new one that all executors reach; returns the manifest that is stored there.

    The texts pass three exchanges, compressed: to their copies, to their range, to their file."""
    files, root = filesystem(folder)
    files.create_dir(f"{root}/_temporary", recursive=True)
    joined = responses(pages, date).join(copied_payloads(pages, least_revisit), ["payload_key", "length", "salt"], "left")
    needed = F.when(F.col("copied").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), F.col("gz"))
    records = written(placed(joined.withColumn("gz", needed), date), "warc-records")
    # One row per part, that is per task of the sorting stage.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy("part").agg(F.sum("size").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    dealt = records.join(F.broadcast(offsets), "part").withColumn("file", F.floor((F.col("offset") + F.col("at")) / F.lit(file_bytes)).cast("long"))
    count = (records.agg(F.sum("size")).first()[0] or 0) // file_bytes + 1
    manifest = written(temporary_files(dealt, count, folder, date), "warc-attempts")
    committed(manifest, folder).write.parquet(f"{folder}/manifest")
    files.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


# --- reading ----------------------------------------------------------------------------------


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(LINE)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: block is not {length} bytes long")
    return fields, rest[:length]


def members(stream: BinaryIO) -> Iterator[bytes]:
    """Decompressed members of a gzip file, one at a time."""
    inflate, out, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(BLOCK):
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("archive ends inside a record")


def record_row(name: str, record: bytes) -> dict[str, Any]:
    """What a record says, after its digests are recomputed."""
    fields, block = parsed(record)
    kind = fields["warc-type"]
    if fields.get("warc-block-digest", sha1_of := f"sha1:{sha1(block)}") != sha1_of:
        raise ValueError(f"{fields['warc-record-id']}: block digest differs")
    row: dict[str, Any] = dict.fromkeys(("page_id", "refers_to", "payload_bytes", "payload_digest", "payload"))
    row |= {"file": name, "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri")}
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(v) for k, _, v in (h.partition(b":") for h in http.split(b"\r\n")) if k.strip().lower() == b"content-length")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != length or sha1(payload) != digest):
            raise ValueError(f"{row['record_id']}: payload differs")
        row |= {"payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}
        row |= {k: int(v) if (v := fields.get(f)) is not None else None for k, f in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id"))}
    return row


SHAPE = "file string, record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the files in the manifest, a file per task, as a stream. A file or record that differs
    from what the manifest or its own header says is an error."""
    names = [c.split()[0] for c in SHAPE.split(", ")] + (["payload"] if with_payload else [])

    def make() -> Any:
        files, root = filesystem(folder)

        def step(batch: pa.RecordBatch | None) -> Iterator[dict[str, Any]]:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if batch is not None else ():
                count, held, out = -1, 0, {n: [] for n in names}
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        row = record_row(name, record)
                        count, held = count + 1, held + len(record)
                        for n in names:
                            out[n].append(row[n])
                        if held > 16 * BLOCK:
                            yield out
                            held, out = 0, {n: [] for n in names}
                yield out
                if count != expected:
                    raise ValueError(f"{name}: {count} records, not {expected}")

        return step

    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "records")
    dealt = manifest.repartition(max(1, min(10_000, manifest.count())))
    return scan(dealt, make, SHAPE + (", payload binary" if with_payload else ""))


def op11_warc_sharded_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    kept = read_archives(spark, folder).where("record_type IN ('response', 'revisit')")
    return kept.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
