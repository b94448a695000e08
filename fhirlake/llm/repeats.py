"""Byte strings of a fixed length that occur more than once, over all texts, and their removal.

Suffixes of all partitions are interleaved and refined without ever being sorted as a whole. A group of suffixes
that share a prefix is named by a fingerprint of it, so that a refinement is one count per name: groups of
one suffix are settled (nothing repeats there), groups that share the full length are repeated intervals, and
only what is between goes on to a longer prefix. There are three depths:

1. `GRAM` bytes, at anchors. The anchor of a string of `length` bytes is the position in it with the smallest
   hash of `GRAM` bytes, the leftmost of equals. It depends on the string alone, so equal strings have equal anchors at
   equal distances. Neighbouring strings mostly share their anchor, which leaves few rows. Anchors whose bytes
   occur once are dropped: no string around them can repeat.
2. Blocks of `BLOCK` starts at equal distances before an anchor. What all strings of a block have in common
   is its core, what they cover together its context. A core that occurs once settles the block as not repeated, a context that
   occurs twice settles all of it as repeated.
3. Single starts in blocks that are still open, at the full length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.spans import RUN_BYTES, RangeHash, U, groups, mix, text_bytes
from fhirlake.sources.shared import through_table

LENGTH = 400
GRAM, BLOCK = 32, 32
LOW = U(0xFFFFFFFF)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, in three passes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at `begins`, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - before, sizes)


def anchors(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per run of strings with one anchor: text, place in it, least and most distance to a start, hash."""
    sizes = np.maximum(np.diff(starts) - length + 1, 0)
    if not sizes.any():
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U),)
    at = np.arange(len(raw) - GRAM + 1)
    hashes = RangeHash(raw)(at, at + GRAM)
    least = sliding_minimum((hashes & ~LOW) | at.astype(U), length - GRAM + 1) & LOW
    begin = ranges(starts[:-1], sizes)
    anchor = least[begin].astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    a, t = anchor[first], text[first]
    return t, a - starts[t], a - begin[last], a - begin[first], hashes[a]


def blocks(
    raw: np.ndarray, starts: np.ndarray, text: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """Per block around the given anchors: text, first start, fingerprints of core and context."""
    each = hi // BLOCK - lo // BLOCK + 1
    number = ranges(lo // BLOCK, each)
    text, at = np.repeat(text, each), np.repeat(at, each)
    begin, end = starts[text], starts[text + 1]
    place = begin + at
    near = place - number * BLOCK
    first = near - BLOCK + 1
    named = mix(RangeHash(raw)(place, place + GRAM) + number.astype(U))
    core = RangeHash(raw)(near, first + length) ^ named
    inside = (first >= begin) & (near + length <= end)
    hashed = RangeHash(raw, 1)
    context = mix(np.arange(len(text), dtype=U))  # replaced below; outside the text nothing can equal it
    context[inside] = hashed(first[inside], near[inside] + length)
    return text, first - begin, core, context, inside


def runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of a batch in runs of bounded size: (first, after, bytes, starts from 0)."""
    raw, starts = text_bytes(batch.column(column))
    for first, after in groups(starts, RUN_BYTES):
        own = starts[first : after + 1]
        yield first, after, raw[own[0] : own[-1]], own - own[0]


def lists(column: pa.Array, field: str) -> np.ndarray:
    return column.flatten().field(field).to_numpy(zero_copy_only=False).astype(np.int64)


def list_sizes(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Repeats:
    """Finds the repeated strings of `docs`; the texts are laid out once, by row, for all later passes.

    `texts` has `row` (names the row), `doc_id` and `text` (null becomes empty).
    """

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> None:
        if length < GRAM + BLOCK:
            raise ValueError(f"length must be at least {GRAM + BLOCK}")
        self.length = length
        self.spark = docs.sparkSession
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("doc_id"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        # Bucketed by row: the texts are dealt out once, and what is found about them comes to them.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"llm_texts_{uuid.uuid4().hex}"
        rows.repartition(buckets, "row").write.bucketBy(buckets, "row").option("compression", "zstd").saveAsTable(name)
        self.texts = self.spark.table(name)

    def _anchors(self) -> DataFrame:
        length = self.length

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for first, after, raw, starts in runs(batch, 1):
                    text, at, lo, hi, hashes = anchors(raw, starts, length)
                    found = [hashes.view(np.int64), rows[first:after][text], at, lo.astype(np.int32), hi.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["gram", "row", "at", "lo", "hi"])

        long = self.texts.select("row", "text").filter(F.octet_length("text") >= length)
        schema = "gram long, row long, at long, lo int, hi int"
        return through_table(long.mapInArrow(find, schema), "repeats-anchors")

    def _at_texts(self, found: DataFrame, *fields: str) -> DataFrame:
        """The texts that anything was found about, with the list of it."""
        per_row = found.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("found"))
        return self.texts.select("row", "text").join(per_row.hint("shuffle_hash"), "row")

    def _blocks(self, repeated: DataFrame) -> DataFrame:
        length = self.length

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for first, after, raw, starts in runs(batch, 1):
                    own = batch.column(2).slice(first, after - first)
                    owner = np.repeat(np.arange(after - first), list_sizes(own))
                    text, begin, core, context, inside = blocks(
                        raw, starts, owner, lists(own, "at"), lists(own, "lo"), lists(own, "hi"), length
                    )
                    row = rows[first:after][text]
                    lone = ~inside
                    context[lone] = mix(row[lone].astype(U) * U(0x9E3779B97F4A7C15) + begin[lone].astype(U))
                    found = [row, begin, core.view(np.int64), context.view(np.int64), inside]
                    yield pa.RecordBatch.from_arrays(
                        list(map(pa.array, found)), names=["row", "begin", "core", "context", "inside"]
                    )

        schema = "row long, begin long, core long, context long, inside boolean"
        return through_table(self._at_texts(repeated, "at", "lo", "hi").mapInArrow(cut, schema), "repeats-blocks")

    def _starts(self, blocks: DataFrame) -> DataFrame:
        """The single starts of the blocks, each once, with two fingerprints of their full length."""
        length = self.length

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for first, after, raw, starts in runs(batch, 1):
                    own = batch.column(2).slice(first, after - first)
                    owner = np.repeat(np.arange(after - first), list_sizes(own) * BLOCK)
                    begins = (lists(own, "begin")[:, None] + np.arange(BLOCK)).reshape(-1)
                    place = begins + starts[owner]
                    fits = (begins >= 0) & (place + length <= starts[owner + 1])
                    place = np.unique(place[fits])
                    text = np.searchsorted(starts, place, "right") - 1
                    prints = [RangeHash(raw, salt)(place, place + length).view(np.int64) for salt in (0, 1)]
                    found = [rows[first:after][text], place - starts[text], *prints]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["row", "begin", "p", "q"])

        schema = "row long, begin long, p long, q long"
        return through_table(self._at_texts(blocks, "begin").mapInArrow(cut, schema), "repeats-starts")

    def intervals(self) -> DataFrame:
        """(row, from, to): byte ranges covered by repeated strings; they may overlap, none is left out."""
        found = self._anchors()
        twice = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
        # written, so that both sides of the join are plain shuffles and adaptive execution can split a frequent gram
        twice = through_table(twice, "repeats-grams")
        cut = self._blocks(found.join(twice, "gram").select("row", "at", "lo", "hi"))

        # A core's contexts, how often each comes, and one place of each.
        one = F.min(F.struct("row", "begin")).alias("one")
        contexts = cut.groupBy("core", "context").agg(F.count("*").alias("same"), one)
        cores = contexts.groupBy("core").agg(F.sum("same").alias("all")).filter("all > 1")
        contexts = through_table(contexts.join(cores, "core"), "repeats-contexts")
        named = cut.join(contexts.select("core", "context", "same"), ["core", "context"])
        whole = named.filter("same > 1").select(
            "row", F.col("begin").alias("from"), (F.col("begin") + BLOCK - 1 + self.length).alias("to")
        )
        alone = named.filter("same = 1").select("row", "begin")
        # a settled context can still hold strings of open ones: one place of it goes on as a witness
        witness = contexts.filter("same > 1 and all > same").select("one.row", "one.begin")
        starts = self._starts(alone.unionByName(witness))
        twice = starts.groupBy("p", "q").agg(F.count("*").alias("n")).filter("n > 1").select("p", "q")
        twice = through_table(twice, "repeats-prints")
        single = starts.join(twice, ["p", "q"])
        single = single.select("row", F.col("begin").alias("from"), (F.col("begin") + self.length).alias("to"))
        return through_table(whole.unionByName(single), "repeats-intervals")

    def removed(self, with_kept: bool = True) -> DataFrame:
        """Per row of the input what is left without the repeated strings; see `remove_repeats`."""
        per_row = self.intervals().groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("found"))
        rows = self.texts.join(per_row.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "found")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, starts = text_bytes(batch.column(1))
                ends = np.cumsum(list_sizes(batch.column(2)))
                begin, end = lists(batch.column(2), "from"), lists(batch.column(2), "to")
                out: dict[str, list] = {c: [] for c in columns}
                for n in range(batch.num_rows):
                    body = raw[starts[n] : starts[n + 1]]
                    spans = merged(begin, end, ends[n - 1] if n else 0, ends[n])
                    keep = np.append(0, spans.reshape(-1)), np.append(spans.reshape(-1), len(body))
                    kept = b"".join(body[a:b].tobytes() for a, b in zip(keep[0][::2], keep[1][::2]))
                    out["n_bytes"].append(len(body))
                    out["n_removed"].append(len(body) - len(kept))
                    out["n_spans"].append(len(spans))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["removed"].append(len(spans) > 0)
                    out["spans"].append([{"from": int(a), "to": int(b)} for a, b in spans])
                    if with_kept:
                        out["kept"].append(kept)
                found = [pa.array(out[c], t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *columns])

        columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "spans"]
        ranges = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), ranges]
        kind = rows.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        schema += ", removed boolean, spans array<struct<from: bigint, to: bigint>>"
        if with_kept:
            columns += ["kept"]
            types += [pa.binary()]
            schema += ", kept binary"
        return rows.mapInArrow(cut, schema)


def merged(begin: np.ndarray, end: np.ndarray, first: int, after: int) -> np.ndarray:
    """The maximal runs covered by some of the ranges, as pairs."""
    begin, end = begin[first:after], end[first:after]
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(begin)) - 1
    return np.stack([begin[at], reach[last]], axis=1) if len(at) else np.empty((0, 2), np.int64)


def remove_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = True
) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that also starts elsewhere.

    Strings are compared as UTF-8 bytes over all rows, within a row too; they never cross rows, and their
    occurrences may overlap. All occurrences are removed, judged on the input. Per row: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 (lower-case hex of the bytes left), removed (whether any
    byte is), spans (the runs, from and to in bytes), and unless `with_kept` is false `kept` (binary: a cut may part a character).

    A null text is empty; texts shorter than `length` lose nothing. Repeated rows remove each other's bytes. Keys may
    be null or repeated. Other columns are not read. An empty table gives no rows.
    """
    return Repeats(docs, key=key, text=text, length=length).removed(with_kept)
