"""Concatenate and cut: documents as one token stream, cut into windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.llm.encode import BATCH_BYTES, Encoder
from fhirlake.llm.spans import groups, releasing, text_bytes
from fhirlake.sources.shared import shared_dir


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """First pass: per document its ids with the end id, and where it starts in its partition.

    Written in the shared folder: the second pass must see the same partitions, and a lost executor
    must not change them.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @releasing
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        block = TaskContext.get().partitionId()
        at = 0
        for batch in batches:
            raw, begins = text_bytes(batch.column(1))
            for first, after in groups(begins, BATCH_BYTES):
                counts, ids = encoder.batch(batch.column(1).slice(first, after - first))
                stream = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts += 1
                ends = np.cumsum(counts)
                cuts = np.append(0, ends * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, after - first),
                        pa.array(np.full(after - first, block, np.int64)),
                        pa.array(at + ends - counts),
                        pa.array(counts),
                        pa.Array.from_buffers(pa.binary(), after - first, [None, pa.py_buffer(cuts), pa.py_buffer(stream)]),
                    ],
                    names=["doc_id", "block", "block_start", "doc_tokens", "ids"],
                )
                at += int(ends[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block long, block_start long, doc_tokens long, ids binary"
    path = shared_dir(docs.sparkSession, "packing")
    # ids fit in two bytes and repeat; the stronger codec more than halves the table
    rows.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def block_offsets(streams: DataFrame) -> DataFrame:
    """Tokens before each partition: one row per partition of the first pass."""
    totals = streams.groupBy("block").agg(F.sum("doc_tokens").alias("tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("block_offset"))


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    window: int = 2048,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents in windows of `window` ids; every window but the last is full.

    The documents' ids, each followed by `end_id`, form one stream in the order of the input's
    partitions. Two passes: token totals of the partitions give each partition's offset by a
    prefix sum, then each document is cut at the multiples of `window`. The second pass moves no rows between tasks.

    One row per piece: `doc_id`, `start` (ids of the document before it), `length`, `ids` (binary,
    little-endian unsigned 32 bit), `doc_tokens` (with the end id), `sequence_id`, `offset` (place in the
    window). A window's rows, ordered by `offset`, are its boundary records.

    A null or empty text has the end id alone, so every row has a piece. Repeated rows, equal
    keys and null keys are packed one by one. Other columns are not read. An empty table gives no rows.
    """
    streams = tokenized(docs, vocabulary, end_id, key, text)
    # One small row per partition of the input: what is broadcast is bounded by the number of tasks.
    placed = streams.join(F.broadcast(block_offsets(streams)), "block")
    first = F.col("block_offset") + F.col("block_start")
    placed = placed.select("doc_id", "doc_tokens", "ids", first.alias("first"))
    last = F.col("first") + F.col("doc_tokens") - 1
    pieces = placed.select(
        "*", F.explode(F.sequence(F.expr(f"first div {window}"), (last / window).cast("long"))).alias("sequence_id")
    )
    begin = F.greatest(F.col("first"), F.col("sequence_id") * window)
    end = F.least(F.col("first") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    start, length = begin - F.col("first"), end - begin
    return pieces.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (begin - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window: its ids in order and its boundary records.

    A window has at most as many pieces as ids, so the groups are bounded.
    """
    record = F.struct("offset", "doc_id", "start", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    return whole.select(
        "sequence_id",
        F.aggregate("records", F.lit(b""), lambda got, r: F.concat(got, r["ids"])).alias("ids"),
        F.transform("records", lambda r: r.dropFields("ids")).alias("boundaries"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids instead of the ids."""
    crc = F.crc32("ids").cast("long").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
