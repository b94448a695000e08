"""Importance resampling towards a target: hashed n-gram features, log ratios per bucket, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.ordering import numbered
from fhirlake.llm.prefix_crc import between, running
from fhirlake.llm.spans import BLANK, groups, text_bytes
from fhirlake.sources.shared import through_table

#: Texts are scanned in runs of about so many bytes (a longer text is a run of its own).
RUN_BYTES = 1 << 19
#: What each byte becomes: A-Z their lower case, other word bytes themselves, all others a blank.
NORMAL = np.full(256, BLANK, np.uint8)
NORMAL[0x30:0x3A] = np.arange(0x30, 0x3A)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
NORMAL[0x80:] = np.arange(0x80, 0x100)


class Words:
    """The words of many texts of one byte array, one separator after each, in one array."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray) -> None:
        # a separator after each text keeps words of neighbours apart
        texts = np.diff(starts)
        data = NORMAL[np.insert(raw[starts[0] : starts[-1]], starts[1:] - starts[0], BLANK)]
        ends_of_texts = np.cumsum(texts + 1)
        word = data != BLANK
        after_word = np.append(False, word[:-1])
        kept = word | after_word  # each word and the first separator after it
        place = np.cumsum(kept) - kept
        self.raw = data[kept]
        self.first = place[np.flatnonzero(word & ~after_word)]
        self.last = place[np.flatnonzero(~word & after_word)]
        until = np.searchsorted(np.flatnonzero(word & ~after_word), ends_of_texts)
        self.counts = np.diff(until, prepend=0)

    def features(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, CRC-32) of all runs of 1 to `most` words, by text."""
        registers = running(self.raw)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        owners, codes = [], []
        for n in range(most):
            same = owner[n:] == owner[: len(owner) - n] if n else np.ones(len(owner), bool)
            begin = np.flatnonzero(same)
            owners.append(owner[begin])
            codes.append(between(registers, self.first[begin], self.last[begin + n]))
        order = np.argsort(np.concatenate(owners), kind="stable")
        return np.concatenate(owners)[order], np.concatenate(codes)[order]


def featured(docs: DataFrame, key: str, text: str, most_words: int, buckets: int) -> DataFrame:
    """Per row: `doc_id`, `n_words`, `n_features` and `buckets`, the features' buckets (binary, little-endian)."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_bytes(batch.column(1))
            for first, after in groups(starts, RUN_BYTES):
                words = Words(raw, starts[first : after + 1])
                owner, codes = words.features(most_words)
                found = (codes % np.uint32(buckets)).astype(width)
                counts = np.bincount(owner, minlength=after - first)
                cuts = np.append(0, np.cumsum(counts) * found.itemsize).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), after - first, [None, pa.py_buffer(cuts), pa.py_buffer(found)])
                columns = [batch.column(0).slice(first, after - first), pa.array(words.counts), pa.array(counts), blob]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def histogram(features: DataFrame, buckets: int) -> DataFrame:
    """`bucket`, `n`: features per bucket. Each task counts its own rows, so at most `buckets` rows a task move."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                seen += np.bincount(np.frombuffer(blob.as_buffer(), width), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """`bucket`, `gain`: the floored log ratio in thousandths, smoothed by one feature a bucket. `buckets` rows."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = (
        every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    )
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(features: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """Per row the floored mean of its features' gains; 0 without features."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            sums = [int(gain[np.frombuffer(b.as_buffer(), width)].sum()) for b in batch.column("buckets")]
            weight = np.array(sums, np.int64) // np.maximum(n, 1)
            kept = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """A Gumbel variable in thousandths, from the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    share: int = 25,
    least_words: int = 20,
    most_words: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Draws `share` per cent of the documents with at least `least_words` words, by importance for `target`.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case; features are all
    runs of 1 to `most_words` words joined by a blank, hashed by CRC-32 into `buckets`. Each text is scanned once
    with running CRCs; every feature's CRC comes from two of them. A bucket's gain is 1000 times the log of its share in the target over its
    share in `docs` (each with one more feature a bucket), a document's weight is the mean gain of its features, and the draw takes the
    highest weights plus Gumbel noise from the key, which samples without replacement in proportion to the importance.

    Returns for every row `doc_id`, `n_features`, `weight`, `score`, `rank` (from 1 by score, ties to the smaller key; null if
    not drawn). All counts are over whole texts of all rows. `buckets` rows reach the driver and the tasks, whatever the input's size.

    A null or empty text has no words, weight 0 and is not drawn (unless `least_words` is 0). A null key takes part as an
    empty one and loses ties last. Rows with equal keys have equal noise and are drawn one by one; if they tie, either may
    get the earlier rank. Of both tables only key and text are read, so other columns may have any name. An empty target has a gain for
    every bucket that `docs` uses; an empty `docs` gives no rows.
    """
    features = through_table(featured(docs, key, text, most_words, buckets), "importance-features")
    wanted = featured(target.withColumn("__none", F.lit(0)), "__none", text, most_words, buckets)
    table = gains(histogram(features, buckets), histogram(wanted, buckets), buckets)
    gain = np.array([r["gain"] for r in table.orderBy("bucket").collect()], np.int64)  # one number a bucket
    scored = weighted(features, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = through_table(scored.withColumn("tie", F.monotonically_increasing_id()), "importance-scores")

    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("tie")]
    placed = numbered(scored.filter(able), order)
    drawn = F.col("number") < F.expr(f"{share} * total div 100")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(drawn, F.col("number") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
