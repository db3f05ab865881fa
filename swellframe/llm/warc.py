"""WARC archives with one Zstandard dictionary each and one frame per record.

An archive starts with a skippable frame that holds a dictionary built from the archive's
own records; each record follows as a frame of its own, compressed with that dictionary.
Identical payloads are written once: the others become revisit records.

Tasks write archives of a bounded size under names of their own, and the manifest, written
by Spark, lists those of the attempts that counted. A lost task leaves at most a file that
no manifest names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, functions as F

from swellframe.llm.batches import slices
from swellframe.sources.workspace import fresh_folder

# Fixed values of the public formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"

# Bytes of records, uncompressed, after which a task starts the next archive.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
# Bytes of an archive's records, taken evenly over them, that its dictionary is built from.
DICTIONARY_SAMPLE = 2 << 20
PIECE_BYTES = 4 << 10
LEVEL = 3
REVISIT_BYTES = 1000
DATE = "2024-01-31T00:00:00Z"

MANIFEST = "archive string, n_records long, raw_bytes long, offsets array<long>"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def with_record_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``record_type``, ``refers_to`` and payload facts.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest id is the
    response (each of them, if several rows repeat that id) and the rest revisit it. A null
    payload is empty. Rows without an id are revisits unless all equal rows have none.
    """
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].alias("page_id"),
        pages["url"].alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )
    copies = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
        .filter("n > 1")
        .drop("n")
        .withColumn("copied", F.lit(True))
    )
    joined = rows.join(copies, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("target"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("target")).alias("refers_to"),
    )


def record_bytes(row: dict) -> bytes:
    """A whole WARC record. The HTTP block of a revisit has the headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    page = "none" if row["page_id"] is None else row["page_id"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{RECORD_ID}{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe='%/:=&?~#+!$,;@()*[]')}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        head.append(f"WARC-Refers-To: <{RECORD_ID}{row['refers_to']}>")
    block = http + (row["payload"] or b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def built_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from pieces taken evenly over the whole of all records.

    Where the pieces are too few or too alike to train on, it is some of them as raw content.
    """
    step = max(1, sum(map(len, records)) // DICTIONARY_SAMPLE)
    pieces = [record[at : at + PIECE_BYTES] for record in records for at in range(0, len(record), PIECE_BYTES)][::step]
    total = sum(map(len, pieces))
    size = min(DICTIONARY_BYTES, total // 8)
    if len(pieces) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, pieces, k=512, d=8, level=LEVEL)
        except zstandard.ZstdError:
            pass
    share = max(1, -(-total // DICTIONARY_BYTES))
    raw = b"".join(pieces[::share])[:DICTIONARY_BYTES]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> tuple[bytes, list[int]]:
    """The archive, and where each record's frame starts in it."""
    dictionary = built_dictionary(records)
    content = dictionary.as_bytes()
    out = bytearray(struct.pack("<II", SKIPPABLE_DICTIONARY, len(content)) + content)
    dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    offsets = []
    for record in records:
        offsets.append(len(out))
        out += compressor.compress(record)
    return bytes(out), offsets


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The shared file system of a path, and the path on it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def write_archives(typed: DataFrame, folder: str, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``with_record_types`` rows as archives under ``folder``; returns the manifest,
    which tells where each record's frame starts.

    The manifest is stored under ``folder`` too. An empty table has no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)

        def stored(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            system.create_dir(f"{base}/archives", recursive=True)
            data, offsets = archive_bytes(records)
            # By its name the stream would compress the archive once more.
            with system.open_output_stream(f"{base}/archives/{name}", compression=None) as out:
                out.write(data)
            row = [[f"{folder}/archives/{name}"], [len(records)], [sum(map(len, records))], [offsets]]
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["archive", "n_records", "raw_bytes", "offsets"])

        records: list[bytes] = []
        held = 0
        for batch in batches:
            for part in slices(batch, 64):
                for row in part.to_pylist():
                    records.append(record_bytes(row))
                    held += len(records[-1])
                    if held >= archive_size:
                        yield stored(records)
                        records, held = [], 0
        if records:
            yield stored(records)

    manifest = f"{folder}/manifest"
    typed.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return typed.sparkSession.read.schema(MANIFEST).parquet(manifest)


def _dictionary(start: bytes, stream) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of the leading frame whose first 8 bytes were read."""
    if len(start) == 8 and struct.unpack("<II", start)[0] == SKIPPABLE_DICTIONARY:
        return zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", start)[1]))
    return None


def record_at(stream, offset: int) -> bytes:
    """One record of an archive, by its offset: only the dictionary and its frame are read."""
    dictionary = _dictionary(stream.read(8), stream)
    stream.seek(offset)
    return zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream).readall()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers and blocks of an archive, one after the other."""
    start = stream.read(8)
    dictionary = _dictionary(start, stream)
    if dictionary is not None:
        start = b""
    rest = io.BufferedReader(_Joined(start, stream), 1 << 20)
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(rest, read_across_frames=True)
    lines = io.BufferedReader(plain, 1 << 20)
    while line := lines.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while line := lines.readline().strip():
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        block = lines.read(int(headers["content-length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield headers, block


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a stream."""

    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.start[: len(buffer)] or self.rest.read(len(buffer))
        self.start = self.start[len(buffer) :]
        buffer[: len(data)] = data
        return len(data)


def _page(value: str | None) -> int | None:
    number = value.strip("<>").removeprefix(RECORD_ID) if value else "none"
    return None if number == "none" else int(number)


def facts_of(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS. A response's payload is measured, a revisit's is as its headers say."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        lines = [line.partition(b": ") for line in http.split(b"\r\n")]
        size = next(int(value) for name, _, value in lines if name == b"Content-Length")
    return (
        _page(headers["warc-record-id"]),
        headers.get("warc-target-uri"),
        size,
        digest,
        headers["warc-type"],
        _page(headers.get("warc-refers-to")),
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's archives, each read from start to end in a task.

    There are as many tasks as archives, whose names are too short to tell how much work they are.
    """
    names = [part.split()[0] for part in RECORDS.split(", ")]
    types = [pa.string() if part.endswith("string") else pa.int64() for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _file_system(archive)
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream):
                        rows.append(facts_of(headers, block))
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    tasks = max(1, manifest.count())
    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all ``pages`` as archives, then reads them back; see ``with_record_types``."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_record_types(pages), folder))
