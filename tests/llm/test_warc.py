"""Archives: round trip, determinism, lost attempts, broken files, and brute force over the query."""

import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from featureops.llm import warc
from featureops.llm.common import table
from featureops.session import scratch_path

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://b.example/ü", ""),
    (5, "http://c.example", "é" * 40_000), (5, "http://c.example", "é" * 40_000), (6, "http://c.example", "é" * 40_000), (7, "u", "WARC/1.1\r\n\r\n\r\n"),
    (None, "n", "only without id"), (None, "n", "only without id"), (None, "n", "<p>one</p>"), (8, "http://d.example", "x" * 3_000_000),
    (9, "a", "tie"), (9, "b", "tie"), (10, "a", "other"), (10, "a", "other text under the same id"),
]


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        k = html or ""
        first[k] = min((x for x in (first.get(k), i) if x is not None), default=None)
    out, taken = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "", r[1] or "")):
        data = (html or "").encode()
        k = html or ""
        response = len(data) < least or (i == first[k] and k not in taken)
        taken |= {k} if i == first[k] else set()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[k]))
    return sorted(out, key=str)


def got(df):
    rows = df.where("record_type <> 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return rows.select("*", *(F.lit("x").alias(c) for c in ("gz", "file", "part", "size", "length", "n", "salt")))


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, pages, least):
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(pages, folder, 2_000, least).collect()
    read = warc.read_archives(spark, folder, with_payload=True)
    assert got(read) == brute(ROWS, least)
    assert len(manifest) > 1 and sum(r.records for r in manifest) == len(ROWS)
    full = [r for r in read.collect() if r.record_type == "response"]
    texts = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert {(r.page_id, bytes(r.payload)) for r in full} <= texts and len({r.record_id for r in read.collect()}) == len(ROWS) + len(manifest)
    ids = {r.record_id for r in full}
    for row in manifest:
        files, root = warc.filesystem(folder)
        data = files.open_input_stream(f"{root}/{row.name}", compression=None).read()
        assert hashlib.sha256(data).hexdigest() == row.sha256 and len(data) == row.bytes
        # every member can be read by itself, and revisits name a written response
        for record in warc.members(files.open_input_stream(f"{root}/{row.name}", compression=None)):
            fields, _ = warc.parsed(record)
            uuid.UUID(fields["warc-record-id"][10:-1])
            assert fields["warc-type"] != "revisit" or fields["warc-refers-to"] in ids
        assert gzip.decompress(data).count(b"WARC-Type: ") == row.records + 1


def test_files_depend_on_the_rows_alone(spark):
    rows = [(g, f"http://h{g % 5}/", f"<p>{g % 40}</p>" * (g % 50)) for g in range(500)]
    made = []
    for n in (1, 7):
        folder = scratch_path(spark, "warc")
        df = spark.createDataFrame(rows, SCHEMA).repartition(n, "url")
        made.append(sorted(tuple(r) for r in warc.write_archives(df, folder, 10_000).select("name", "records", "bytes", "sha256").collect()))
    assert made[0] == made[1] and len(made[0]) > 3
    assert all(b < 10_000 + 2_000 for _, _, b, _ in made[0])


def test_lost_attempts_and_repeated_moves(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder, 2_000)
    files, root = warc.filesystem(folder)
    names = [r.name for r in spark.read.parquet(f"{folder}/manifest").collect()]
    # an unlisted file of a lost attempt is never read; moving again does nothing
    with files.open_output_stream(f"{root}/pages-99999999.warc.gz", compression=None) as f:
        f.write(b"half a rec")
    again = spark.read.parquet(f"{folder}/manifest").withColumn("temporary", F.lit(f"{root}/_temporary/gone"))
    assert sorted(r.name for r in warc.committed(again, folder).collect()) == sorted(names)
    assert got(warc.read_archives(spark, folder)) == brute(ROWS)


def test_broken_archives_are_errors(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder)
    files, root = warc.filesystem(folder)
    name = spark.read.parquet(f"{folder}/manifest").first().name
    data = files.open_input_stream(f"{root}/{name}", compression=None).read()
    for broken in (data[:-9], data[: len(data) // 2]):
        with files.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(broken)
        with pytest.raises(Exception, match="archive ends inside|records, not|incomplete|error"):
            warc.read_archives(spark, folder).count()
    good = warc.page_record("response", 1, "u", warc.sha1(b"a"), 1, b"a", b"", 0, None, None, warc.DATE)
    for old, new in ((b"\r\n\r\na\r\n", b"\r\n\r\nb\r\n"), (b"Content-Length: 1\r\n", b"Content-Length: 2\r\n"), (b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(ValueError):
            warc.record_row("f", gzip.decompress(good).replace(old, new))


def test_empty_table(spark, pages):
    folder = scratch_path(spark, "warc")
    assert warc.write_archives(pages.limit(0), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    assert got(warc.op11_warc_sharded_writer(spark, "/root/testdata/sf0.01")) == brute(rows)
