"""Benchmark passages in documents: SimHash of item-sized windows, multi-index search, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.shingling import SIMILARITY, WORDS, normal, text_key, weighted_jaccard
from fhirlake.llm.spans import RUN_BYTES, Shingles, U, groups, mix, multiset, occurrences, releasing, text_bytes
from fhirlake.sources.shared import through_table

#: 128-bit fingerprints in 8 blocks of 16 bits. Within a radius of 31 some block differs in at most 3 bits. At
#: similarity 0.8 a fingerprint lies 19 bits off on average, and within the radius in 998 of 1000 cases.
BITS, BLOCKS, RADIUS = 128, 8, 31
BLOCK_BITS = BITS // BLOCKS
#: So many shingles of the benchmark are held by a task at a time; a larger benchmark is searched in slices.
SLICE_SHINGLES = 1 << 21


def simhash(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (n x 2 words of 64 bits) of multisets given as numbered occurrences; `owner` is sorted."""
    out = np.zeros((n, 2), U)
    starts = np.searchsorted(owner, np.arange(n + 1))
    for first, after in groups(starts, 1 << 16):  # in bounded steps: a bit takes a byte here
        own = values[starts[first] : starts[after]]
        if not len(own):
            continue
        hashed = np.stack([mix(own ^ U(0x2545F4914F6CDD1D)), mix(own ^ U(0x9FB21C651E98DF25))], axis=1)
        bits = np.unpackbits(hashed.view(np.uint8), axis=1)
        some = np.flatnonzero(np.diff(starts[first : after + 1])) + first
        sums = np.add.reduceat(bits, starts[some] - starts[first], axis=0, dtype=np.int32)
        sizes = (starts[some + 1] - starts[some])[:, None]
        out[some] = np.packbits(2 * sums > sizes, axis=1).view(U)
    return out


def near_keys(bits: int, radius: int) -> np.ndarray:
    """All differences of up to `radius` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)])


def block_key(block: int):
    """A 16-bit block of the fingerprint (columns high and low), as a column."""
    word, shift = ("high", block) if block < BLOCKS // 2 else ("low", block - BLOCKS // 2)
    return F.shiftrightunsigned(F.col(word), shift * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")


def flat_lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def described(benchmark: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Per item with words: item_id, words, shingles (numbered), grams (plain hashes), high and low."""
    body = benchmark.select(F.col(key).alias("item_id"), normal(F.col(text)).alias("body")).filter("body != ''")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_bytes(batch.column(1))
            for first, after in groups(starts, RUN_BYTES):
                found = Shingles(raw, starts[first : after + 1], words)
                owner, hashes, number = occurrences(found.owner, found.hashes)
                values = multiset(hashes, number)
                prints = simhash(owner, values, after - first).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, after - first),
                        pa.array(found.words),
                        flat_lists(found.counts, values.view(np.int64)),
                        flat_lists(found.counts, hashes.view(np.int64)),
                        pa.array(prints[:, 0]),
                        pa.array(prints[:, 1]),
                    ],
                    names=["item_id", "words", "shingles", "grams", "high", "low"],
                )

    kind = body.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, words long, shingles array<long>, grams array<long>, high long, low long"
    return through_table(body.mapInArrow(describe, schema), "benchmark-items")


def grams(raw: np.ndarray, starts: np.ndarray, width: int, shorter: bool) -> tuple[Shingles, np.ndarray]:
    """Shingles of the texts and which of them count: a text too short for one has none, unless `shorter`."""
    found = Shingles(raw, starts, width)
    return found, np.ones(len(found.owner), bool) if shorter else (found.words >= width)[found.owner]


def windows(docs: DataFrame, known: np.ndarray, lengths: np.ndarray, words: int, similarity: float) -> DataFrame:
    """Item-sized windows that may hold an item: doc_id, node, start (word), words, shingles, high, low.

    `known` are the hashes of the benchmark's shingles (sorted) and `lengths` the items' lengths in words, a row for each
    shingle and length. A window is looked at if it starts with a shingle of an item of its length and has
    enough such shingles to reach the similarity. None is missed: of two windows of one length, that
    which starts at the first matching shingle of the other holds all its matches.
    """
    table = docs.sparkSession.sparkContext.broadcast((known, lengths))  # bounded by SLICE_SHINGLES

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = table.value
        widths = sorted({min(int(n), words) for n in np.unique(lengths)})
        # a small filter by the lowest bits, before the search among all
        seen = np.zeros(1 << 24, bool)
        seen[known & U((1 << 24) - 1)] = True
        for batch in batches:
            raw, starts = text_bytes(batch.column(2))
            for first, after in groups(starts, RUN_BYTES):
                names = [batch.column(i).slice(first, after - first) for i in (0, 1)]
                for width in widths:
                    found, counted = grams(raw, starts[first : after + 1], width, False)
                    maybe = np.flatnonzero(counted & seen[found.hashes & U((1 << 24) - 1)])
                    low = np.searchsorted(known, found.hashes[maybe], "left")
                    each = np.searchsorted(known, found.hashes[maybe], "right") - low
                    at = np.repeat(maybe, each)
                    before = np.cumsum(each) - each
                    size = lengths[np.arange(len(at)) + np.repeat(low - before, each)]
                    right = (size == width) if width < words else (size >= words)
                    at, size = at[right], size[right]
                    if not len(at):
                        continue
                    # matches of one length in order of their place; texts lie far enough apart
                    last = np.minimum(at + np.maximum(size - width, 0), found_end(found)[at])
                    step = int(len(found.hashes)) + int(size.max()) + 1
                    order = np.argsort(size * step + at, kind="stable")
                    at, size, last = at[order], size[order], last[order]
                    line = size * step + at
                    matches = np.searchsorted(line, size * step + last, "right") - np.arange(len(line))
                    enough = matches >= similarity * np.maximum(size - width + 1, 1) - 1e-9
                    at, size, last = at[enough], size[enough], last[enough]
                    count = last - at + 1
                    window = np.repeat(np.arange(len(at)), count)
                    begins = np.cumsum(count) - count
                    inner = found.hashes[np.arange(len(window)) + np.repeat(at - begins, count)]
                    window, inner, number = occurrences(window, inner)
                    values = multiset(inner, number)
                    prints = simhash(window, values, len(at)).view(np.int64)
                    owner = pa.array(found.owner[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            names[0].take(owner),
                            names[1].take(owner),
                            pa.array(found.place[at]),
                            pa.array(size),
                            flat_lists(count, values.view(np.int64)),
                            pa.array(prints[:, 0]),
                            pa.array(prints[:, 1]),
                        ],
                        names=["doc_id", "node", "start", "words", "shingles", "high", "low"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, node binary, start long, words long, shingles array<long>, high long, low long"
    return docs.mapInArrow(search, schema)


def found_end(found: Shingles) -> np.ndarray:
    """For each shingle the last one of its text."""
    ends = np.cumsum(found.counts) - 1
    return ends[found.owner]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Where documents hold benchmark items: doc_id, node, item_id, start (word), words, similarity; one row per document and item.

    Words are lower-case runs of letters and digits; a window has as many words as the item (fewer at the text's end). It
    holds the item if the weighted Jaccard similarity of their shingles of `words` words is at least `similarity`; an item of fewer
    words is one shingle and must occur word for word. Of several windows the most similar, then the first, is reported.

    Window and item must have fingerprints within the radius (see RADIUS); the blocks find all those pairs. Equal windows
    are searched and verified once. Items without words are never found; nor are documents without words. `node` names the
    normal text (see `shingling.text_key`). Rows with equal doc_id and normal text are one document. Null
    keys take part. With an empty table on either side there are no rows.
    """
    items = described(benchmark, item_key, item_text, words)
    body = docs.select(F.col(key).alias("doc_id"), normal(F.col(text)).alias("body"))
    body = body.select("doc_id", text_key(F.col("body")).alias("node"), "body").filter("node is not null")

    plain = items.select("words", F.explode("grams").alias("gram")).distinct()
    slices = -(-plain.count() // SLICE_SHINGLES)
    found = None
    for number in range(slices):
        part = plain.filter(F.pmod(F.xxhash64("gram"), F.lit(slices)) == number) if slices > 1 else plain
        rows = part.toArrow()
        known = rows["gram"].to_numpy().view(U)
        order = np.argsort(known, kind="stable")
        more = windows(body, known[order], rows["words"].to_numpy()[order], words, similarity if slices == 1 else 0.0)
        found = more if found is None else found.unionByName(more)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    if found is None:
        schema = f"doc_id {kind}, node binary, item_id {item_kind}, start long, words long, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    content = F.struct(F.xxhash64("shingles"), F.xxhash64(F.lit(1), "shingles"), "words").alias("content")
    found = through_table(found.withColumn("content", content), "benchmark-windows")

    distinct = found.groupBy("content").agg(*(F.first(c).alias(c) for c in ("shingles", "high", "low")))
    distinct = through_table(distinct, "benchmark-distinct")
    changes = F.array(*map(F.lit, near_keys(BLOCK_BITS, RADIUS // BLOCKS).tolist()))
    keys = F.array(*(F.struct(F.lit(b).alias("block"), block_key(b).alias("bits")) for b in range(BLOCKS)))
    probes = items.select("item_id", "words", F.col("high").alias("h"), F.col("low").alias("l"), F.explode(keys).alias("at"))
    probes = probes.withColumn("change", F.explode(changes)).select(
        "item_id", F.col("words").alias("length"), "h", "l", "at.block", F.col("at.bits").bitwiseXOR(F.col("change")).alias("bits")
    )
    asked = distinct.select("content", "high", "low", F.explode(keys).alias("at"))
    asked = asked.select("content", F.col("content.words").alias("length"), "high", "low", "at.block", "at.bits")
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("h"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("l")))
    # never broadcast: there are thousands of probes per item, which the estimate of their size leaves out
    near = asked.join(probes.hint("merge"), ["length", "block", "bits"]).filter(apart <= RADIUS)
    near = near.select("content", "item_id").distinct()

    of_items = items.select("item_id", F.col("shingles").alias("of_item"))
    same = near.join(distinct.select("content", "shingles"), "content").join(of_items, "item_id")
    same = same.withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("of_item")))
    same = same.filter(F.col("similarity") >= similarity).select("content", "item_id", "similarity")
    places = found.select("content", "doc_id", "node", "start", "words").join(same, "content")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "words")).alias("best")
    return places.groupBy("doc_id", "node", "item_id").agg(best).select(
        "doc_id", "node", "item_id", (-F.col("best.back")).alias("start"), "best.words", "best.similarity"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """`docs` without the rows whose text holds an item of the benchmark. Rows without words stay."""
    held = through_table(contaminated(docs, benchmark, text=text, **settings).select("node").distinct(), "benchmark-held")
    # the row as one column, so that its names cannot clash with others
    marked = docs.select(F.struct("*").alias("row"), text_key(normal(F.col(text))).alias("node"))
    return marked.join(held, "node", "left_anti").select("row.*")
