"""Near duplicates by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.shingling import SIMILARITY, WORDS, normal, text_key, weighted_jaccard
from fhirlake.llm.spans import RUN_BYTES, Shingles, U, groups, mix, multiset, occurrences, releasing, text_bytes
from fhirlake.sources.shared import through_table

#: Signature length and rows per band: at similarity 0.8 a pair is missed with probability 6e-5.
COORDINATES, BAND_ROWS = 192, 6
#: Members that a band's texts are compared with first are drawn in so many ways.
LEADER_ORDERS = 4
#: Texts of one band are compared in blocks of about so many.
BLOCK_TEXTS = 256
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(owner: np.ndarray, cells: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash signatures (n x k) of n weighted sets.

    An element of weight w has the regions 0 to w - 1, each named by a hash in `cells` (see `multiset`); `owner`
    says whose. Darts hit each region in a random sequence of times that depends on the region's name
    alone, and each dart hits one of k coordinates. A set looks at its regions up to a time by which about
    k ln k + 2k darts have come, whatever its size, and keeps the earliest dart per coordinate; two
    sets keep the same one with a probability of their weighted Jaccard similarity. Sets with an empty
    coordinate look twice as far. Owners must be sorted; sets without elements keep no darts.
    """
    signature = np.full(n * k, NONE, U)
    weight = np.bincount(owner, minlength=n)
    until = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    while len(owner):
        at, whose, throw = np.zeros(len(cells)), owner, 0
        names = cells
        while len(names):
            throw += 1
            dart = mix(names + U(throw * 0xD1342543DE82EF95 % 2**64))
            at = at - np.log(unit(dart))
            hit = at <= until[whose]
            at, whose, names, dart = at[hit], whose[hit], names[hit], dart[hit]
            extra = mix(dart ^ U(0xA0761D6478BD642F))
            coordinate = (extra % U(k)).astype(np.int64)
            # the time's bits order as the times do; the rest tells darts of one time apart
            packed = (at.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (extra >> U(32))
            np.minimum.at(signature, whose * k + coordinate, packed)
        short = (signature.reshape(n, k) == NONE).any(axis=1)
        again = short[owner]
        owner, cells = owner[again], cells[again]
        until *= 2
    return signature.reshape(n, k)


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key per band."""
    n, k = signatures.shape
    keys = np.broadcast_to(np.arange(k // rows, dtype=U), (n, k // rows)).copy()
    for r in range(rows):
        keys = mix(keys * U(0x9FB21C651E98DF25) + signatures[:, r::rows][:, : k // rows])
    return keys


def signed(docs: DataFrame, key: str, text: str, words: int, k: int, rows: int) -> DataFrame:
    """Per document doc_id, node (its normal text's name) and the keys of its bands; written once."""
    body = docs.select(F.col(key).alias("doc_id"), normal(F.col(text)).alias("body"))
    body = body.select("doc_id", text_key(F.col("body")).alias("node"), "body")

    @releasing
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_bytes(batch.column(2))
            for first, after in groups(starts, RUN_BYTES):
                found = Shingles(raw, starts[first : after + 1], words)
                owner, hashes, number = occurrences(found.owner, found.hashes)
                keys = band_keys(dart_signatures(owner, multiset(hashes, number), after - first, k), rows)
                keys = keys.view(np.int64)
                ends = np.arange(after - first + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                some = [batch.column(i).slice(first, after - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*some, lists], names=["doc_id", "node", "bands"])

    kind = body.schema["doc_id"].dataType.simpleString()
    table = body.mapInArrow(sign, f"doc_id {kind}, node binary, bands array<long>")
    return through_table(table, "near-signed")


def shingled(docs: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """The shingle multisets of the given normal texts."""
    body = docs.select(normal(F.col(text)).alias("body"))
    body = body.select(text_key(F.col("body")).alias("node"), "body").filter("node is not null")
    body = body.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_bytes(batch.column(1))
            for first, after in groups(starts, RUN_BYTES):
                found = Shingles(raw, starts[first : after + 1], words)
                owner, hashes, number = occurrences(found.owner, found.hashes)
                ends = np.append(0, np.cumsum(found.counts)).astype(np.int32)
                values = pa.array(multiset(hashes, number).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                nodes = batch.column(0).slice(first, after - first)
                yield pa.RecordBatch.from_arrays([nodes, lists], names=["node", "shingles"])

    return through_table(body.mapInArrow(cut, "node binary, shingles array<long>"), "near-shingles")


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(weighted_jaccard(F.col("of_a"), F.col("of_b")) >= similarity).select("a", "b")


def cell_links(nodes: list[bytes], classes: list[bytes], shingles: pa.ChunkedArray, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between the classes of at most 2 * BLOCK_TEXTS texts; as many as it takes to join what is linked."""
    lists = shingles.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = times[column] > 1  # the others are in no intersection
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # in bounded steps
        a, b = np.searchsorted(column, [lo, lo + 8192])
        holds = np.zeros((len(sizes), 8192), np.float32)
        holds[owner[a:b], column[a:b] - lo] = 1
        common += holds @ holds.T
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    parent = {c: c for c in classes}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        x, y = root(classes[i]), root(classes[j])
        if x != y:
            parent[x] = y
            found.append((nodes[i], nodes[j]))
    return found


def links_within(apart: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of one band that are in different components; `apart` has band, node, component, members.

    A band's texts are dealt to blocks, and each pair of blocks is a cell of bounded size that
    compares its texts exactly. Only links come out, and only those that join two components.
    """
    blocks = F.ceil(F.col("members") / BLOCK_TEXTS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = apart.withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "component")
    rows = rows.join(shingles, "node")

    def compare(cell: pa.Table) -> pa.Table:
        nodes, classes = cell["node"].to_pylist(), cell["component"].to_pylist()
        found = cell_links(nodes, classes, cell["shingles"], similarity) if len(set(classes)) > 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("band", "low", "high").applyInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges: minimum labels with pointer jumping.

    Each round is a written table, so that lineage stays short and a lost executor costs one round.
    """
    both = through_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels = through_table(labels, "near-labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        lowest = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        merged = labels.join(lowest, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "other").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        merged = merged.join(jump, "component").select("node", "before", F.least("component", "further").alias("component"))
        merged = through_table(merged, "near-labels")
        labels = merged.select("node", "component")
        if merged.filter("component != before").isEmpty():
            return labels


def classes(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    coordinates: int = COORDINATES,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Per row of `docs`: doc_id, node (names the normal text, null without words) and class_id.

    Two texts are linked if the weighted Jaccard similarity of their shingles of `words` words (lower case,
    letters and digits only; a shorter text is one shingle) is at least `similarity`; a class is a
    connected component of links, named by its smallest doc_id. Equal normal texts are one node from the start.

    Candidates share a band of their DartMinHash signatures. Every band's group is first compared with one
    member drawn at random, which joins most groups of copies; groups whose members are then still in different
    classes are compared inside cells of bounded size, which give out joining links only. All candidates are verified exactly.

    A null or empty text, or one without words, is alone in a class named by its own doc_id. Null keys take part;
    a class with only null keys has a null name. Repeated rows get a row each. Other columns are not read. An empty
    table gives no rows.
    """
    table = signed(docs, key, text, words, coordinates, band_rows)
    nodes = table.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    bands = nodes.select("node", F.explode("bands").alias("band"))
    # a few orders for all bands, so that large groups of copies mostly meet the same few members
    order = F.xxhash64("node", F.pmod(F.col("band"), F.lit(LEADER_ORDERS)))
    drawn = F.min(F.struct(order.alias("draw"), "node")).getField("node")
    leaders = bands.groupBy("band").agg(F.count("*").alias("members"), drawn.alias("leader")).filter("members > 1")
    shared = through_table(bands.join(leaders, "band"), "near-bands")

    tested = shared.filter("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    tested = through_table(tested.distinct(), "near-pairs")
    shingles = shingled(docs, shared.select("node").distinct(), text, words)
    edges = through_table(verified(tested, shingles, similarity), "near-links")
    found = components(edges)

    # Groups of three or more with members still apart.
    apart = shared.filter("members > 2").select("band", "node").join(found, "node", "left")
    apart = apart.select("band", "node", F.coalesce("component", "node").alias("component"))
    several = apart.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")
    )
    apart = apart.join(several.filter("low != high").select("band", "members"), "band")
    more = through_table(links_within(apart, shingles, similarity), "near-links")
    named = table.select("doc_id", "node").join(found, "node", "left")
    named = named.select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    if not more.isEmpty():
        # components of components
        of_a = found.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
        of_b = found.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
        between = more.join(of_a, "a", "left").join(of_b, "b", "left")
        between = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()
        wider = components(between.filter("a != b")).select(
            F.col("node").alias("component"), F.col("component").alias("wider")
        )
        named = named.join(wider, "component", "left")
        named = named.select("doc_id", "node", F.coalesce("wider", "component").alias("component"))
    names = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    # rows without words have no component and keep their own name
    return named.join(names, "component", "left").select(
        "doc_id", "node", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with one row of each class: that with the smallest key. Rows without words all stay.

    Rows equal in key and normal text are one document; one of them stays. If a class has no key that is
    not null, one of its rows stays.
    """
    found = through_table(classes(docs, key=key, text=text, **settings), "near-classes").filter("node is not null")
    kept = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("k"))
    # a null name is one of several classes: each keeps its own rows' smallest text
    named = kept.filter("class_id is not null").select("k.doc_id", "k.node")
    unnamed = found.filter("class_id is null").select("doc_id", "node").distinct()
    keepers = named.unionByName(unnamed)
    losers = found.select("doc_id", "node").distinct().join(
        keepers.select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")),
        F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("node") == F.col("k_node")),
        "left_anti",
    )
    losers = through_table(losers.select(F.col("doc_id").alias("lost_id"), F.col("node").alias("lost_node")), "near-lost")
    # the row as one column, so that its names cannot clash with others
    marked = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"), text_key(normal(F.col(text))).alias("node"))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("node") == F.col("lost_node"))
    left = marked.join(losers, same, "left_anti")
    repeated = found.groupBy("doc_id", "node").count().filter("count > 1")
    if not repeated.isEmpty():
        worded = left.filter("node is not null").dropDuplicates(["doc_id", "node"])
        left = left.filter("node is null").unionByName(worded)
    return left.select("row.*")
