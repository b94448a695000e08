"""WARC archives with a shared Zstandard dictionary: written by tasks, read back by tasks.

A file starts with a skippable frame that holds the dictionary, then each record is a frame of its own,
so that a record can be read from its offset with the dictionary alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake.llm.sampling import drawn
from fhirlake.sources.shared import shared_dir, through_table

# The skippable frame's magic number for dictionaries and the revisit profile's name.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from so many records, each cut to so many characters.
SAMPLE_RECORDS, SAMPLE_CHARS = 512, 16_384
READ_BYTES = 1 << 20
LEVEL = 3


def record_id(page_id: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def unnamed_id(row: dict) -> str:
    """Of a record without page_id: from what it holds, so that a repeated task writes the same bytes."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{row['record_type']}:{row['url']}:{row['payload_digest']}").urn


def record(row: dict, date: str) -> bytes:
    """A response with the payload, or a revisit with the HTTP header alone."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + row["payload"]
    page = row["page_id"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_id(page) if page is not None else unnamed_id(row)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(row['url'] or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        head.append(f"WARC-Refers-To: <{record_id(row['refers_to'])}>")
        head.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the payload and its digest are those that were stored."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    found = {
        "page_id": fields.get("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("X-Refers-To-Page-ID"),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None,
    }
    if found["record_type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != found["payload_digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        found["payload"] = payload
    return found


def classify(pages: DataFrame, key: str, payload: str, url: str, least: int) -> DataFrame:
    """Each page with its payload's digest, and whether it is stored or refers to an equal one."""
    body = F.coalesce(F.col(payload), F.lit(""))
    page = F.col(key).alias("page_id")
    size = F.octet_length(body).cast("long").alias("payload_bytes")
    digest = F.sha2(body.cast("binary"), 256).alias("payload_digest")
    repeated = (
        pages.select(page, size, digest)
        .filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
        .drop("copies")
    )
    # Written, so that both sides of the join are plain shuffles and adaptive execution can split a payload that many pages share.
    repeated = through_table(repeated, "warc-repeated")
    rows = pages.select(page, F.col(url).alias("url"), body.cast("binary").alias("payload"), size, digest)
    rows = rows.join(repeated, "payload_digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    kind = F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        kind.alias("record_type"),
        refers.cast("string").alias("refers_to"),
    )


def train(pages: DataFrame, key: str, payload: str, url: str, date: str) -> bytes:
    """A dictionary from a bounded sample of the records; empty when there are too few to build one."""
    body = F.substring(F.col(payload), 1, SAMPLE_CHARS)
    sample = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    sample = drawn(sample.filter("payload is not null"), SAMPLE_RECORDS, pages.count(), "page_id", "url", "payload")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = []
        for batch in batches:
            for row in batch.to_pylist():
                body = row["payload"].encode()
                more = {"payload": body, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
                records.append(record(row | more | {"record_type": "response"}, date))
        built = b""
        for size in (DICTIONARY_BYTES >> n for n in (0, 2, 4, 6)):  # few records give a small one
            try:
                built = zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
                break
            except zstandard.ZstdError:
                pass
        yield pa.RecordBatch.from_arrays([pa.array([built], pa.binary())], names=["dictionary"])

    found = sample.coalesce(1).mapInArrow(build, "dictionary binary").first()
    return bytes(found["dictionary"]) if found else b""


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    least: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row into archives under `folder` and returns their manifest (path, records, bytes).

    Payloads are the column's UTF-8 bytes (null: empty). Of records with equal payloads of at least `least` bytes
    those with the smallest key are stored, the others are revisits of it (those with a null key too); if all keys
    are null, all are stored. Rows that repeat the smallest key are all stored. A null URL is
    about:blank. The dictionary is built once from a bounded sample and embedded in every archive; with too few
    records to build one, archives have no dictionary frame. An empty table gives no archive.

    A task names its files by its attempt, and only committed attempts are in the manifest, so that a lost
    executor leaves no half-written archive in it. The folder (default: in spark.checkpoint.dir) must be one
    that pyarrow's file systems can open.
    """
    spark = pages.sparkSession
    folder = (folder or shared_dir(spark, "warc")).rstrip("/")
    dictionary = train(pages, key, payload, url, date)
    rows = classify(pages, key, payload, url, least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, name, records = None, "", 0
        for batch in batches:
            for n in range(batch.num_rows):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.zst"
                    out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                row = batch.slice(n, 1).to_pylist()[0]
                out.write(packer.compress(record(row, date)))
                records += 1
                if out.tell() >= archive_bytes:
                    done.append((name, records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, records, out.tell()))
            out.close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{x}" for x in names], pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(sizes, pa.int64()),
            ],
            names=["path", "records", "bytes"],
        )

    schema = "path string, records long, bytes long"
    manifest = f"{folder}-manifest"
    rows.mapInArrow(write, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def frames(stream) -> Iterator[bytes]:
    """The records of one archive, one after the other."""
    data = stream.read(8)
    shared = None
    if len(data) == 8:
        magic, length = struct.unpack("<II", data)
        if magic == DICTIONARY_MAGIC:
            shared, data = zstandard.ZstdCompressionDict(stream.read(length)), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    while data := data or stream.read(READ_BYTES):
        frame = unpacker.decompressobj()
        parts = [frame.decompress(data)]
        while not frame.eof:
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError("an archive ends inside a record")
            parts.append(frame.decompress(data))
        data = frame.unused_data
        yield b"".join(parts)


def read_archives(spark: SparkSession, manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in the manifest: page_id and refers_to (strings), url, record_type,
    payload_bytes, payload_digest, and the payload (null in revisits).

    Every stored payload is checked against its digest and length; a damaged or cut archive fails the job.
    `payloads=False` leaves the payload column out of the result.
    """
    # Each archive is read by one task; its size is bounded by the writer. The number is given, since adaptive
    # execution would merge the few bytes of the paths into one task.
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    columns += ["payload"] if payloads else []
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parse(data))
                        size += len(data) if payloads else 0
                        if len(rows) == 4096 or size > READ_BYTES * 8:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[dict]) -> pa.RecordBatch:
        found = [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns]
        return pa.RecordBatch.from_arrays(found, names=columns)

    types = {"payload_bytes": "long", "payload": "binary"}
    return files.mapInArrow(read, ", ".join(f"{c} {types.get(c, 'string')}" for c in columns))
