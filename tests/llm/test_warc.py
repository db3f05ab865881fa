"""Archives written and read back."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard
from compare import connection, differences

from swellframe.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string"
LONG = "<p>é</p>" * 400


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op5_warc(spark, sf_dir)
    assert differences(rows, connection(sf_dir), queries.CHECK_OP5) == []


def test_edge_rows(spark):
    rows = [
        (1, "http://a/\r\nX: 1", LONG, "c"), (2, None, LONG, "c"), (2, None, LONG, "c"),
        (3, "u", None, None), (4, "u", "", None), (5, "u", "short", None), (6, "u", "short", None),
        (None, "u", LONG, None), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 90, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = warc.archived(df).collect()
    digest = hashlib.sha1(LONG.encode()).hexdigest()
    size = len(LONG.encode())
    found = [(r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=str) == sorted([
        (0, size, "revisit", 2), (1, size, "revisit", 2),
        (2, size, "response", None), (2, size, "response", None),
        (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None),
        (6, 5, "response", None), (7, 1350, "response", None),
    ], key=str)
    assert {r.payload_digest for r in got if r.page_id in (1, 2)} == {digest}
    assert warc.archived(df.limit(0)).collect() == []


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "u", LONG, None)] * 2, SCHEMA)
    assert [r.record_type for r in warc.archived(df).collect()] == ["response"] * 2


def record_rows(count, repeat=9):
    return [
        {"page_id": i, "url": f"http://h/{i}", "payload": f"<html><p>page {i * 7919} text</p>".encode() * repeat,
         "payload_bytes": 3, "payload_digest": "0", "record_type": "response", "refers_to": None}
        for i in range(count)
    ]


@pytest.mark.parametrize(("count", "repeat"), [(1, 0), (1, 9), (3, 9), (400, 9), (7, 20_000)])
def test_dictionary_frame(count, repeat):
    rows = record_rows(count, repeat)
    records = [warc.record_bytes(row) for row in rows]
    data, offsets = warc.archive_bytes(records)
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE_DICTIONARY
    assert offsets[0] == 8 + struct.unpack("<I", data[4:8])[0]
    read = list(warc.read_records(io.BytesIO(data)))
    assert [warc._page(headers["warc-record-id"]) for headers, _ in read] == list(range(count))
    assert all(block.endswith(row["payload"]) for (_, block), row in zip(read, rows, strict=True))


def test_dictionary_saves_bytes():
    records = [warc.record_bytes(row) for row in record_rows(400, 1)]
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(warc.archive_bytes(records)[0]) < 0.7 * plain


def test_files_on_disk(spark, tmp_path):
    """The bytes of a written archive: leading dictionary, a frame per record, read by offset."""
    rows = [(i, f"http://h/{i}", f"<p>{i * 7919}</p>" * (2000 + i), None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write_archives(warc.with_record_types(df), str(tmp_path), archive_size=100_000)
    archives = manifest.collect()
    assert len(archives) > 8
    pages = []
    for row in archives:
        data = open(row.archive, "rb").read()
        assert data[:4] == bytes.fromhex("5d2a4d18") and len(row.offsets) == row.n_records
        assert all(data[at : at + 4] == bytes.fromhex("28b52ffd") for at in row.offsets)
        for at in row.offsets:
            with open(row.archive, "rb") as stream:
                record = warc.record_at(stream, at)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"</p>\r\n\r\n")
            pages.append(int(record.split(b"x-page:")[1].split(b">")[0]))
    assert sorted(pages) == list(range(60))
    read = warc.read_archives(manifest)
    assert read.rdd.getNumPartitions() == len(archives)
    assert sorted(r.page_id for r in read.collect()) == list(range(60))
