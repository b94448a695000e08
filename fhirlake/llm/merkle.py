"""Merkle manifest of a data set: time-forward processing of a tree, then a reversed sweep for the proofs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.ordering import numbered
from fhirlake.sources.shared import through_table

ARITY = 16
#: Levels that one sweep covers: a unit is a subtree with this height and at most SPAN nodes at its foot.
HEIGHT = 3
SPAN = ARITY**HEIGHT
HEX = 64
_INNER = "tree string, total long, unit long, end long, level int, kids binary, digest string, top boolean"
_FIRST = 1 << 62  # before all labels of a unit in the reversed order


def height_of(total: int) -> int:
    """Levels above the foot of a unit of a tree with `total` nodes there."""
    if total > SPAN:
        return HEIGHT
    return next(h for h in range(HEIGHT + 1) if ARITY**h >= total)


def label_of(level: int, index: int, size: int) -> tuple[int, int]:
    """Labels order nodes by their last foot node, then by level: children come before parents."""
    return min((index + 1) * ARITY**level, size) - 1, level


def size_of(total: int, unit: int) -> int:
    return min(SPAN, total - unit * SPAN)


class Node(NamedTuple):
    """A link of a proof: the run of digests that a node stands in, its place there, and the link above."""

    slot: int
    run: bytes
    above: Node | None


def packed(link: Node | None) -> bytes:
    out = []
    while link is not None:
        out += [bytes([link.slot, len(link.run) // HEX]), link.run]
        link = link.above
    return b"".join(out)


def unpacked(data: bytes) -> Node | None:
    links, at = [], 0
    while at < len(data):
        slot, n = data[at], data[at + 1]
        links.append((slot, data[at + 2 : at + 2 + n * HEX]))
        at += 2 + n * HEX
    return reduce(lambda above, link: Node(*link, above), reversed(links), None)


def proof(link: Node | None) -> str:
    """The digest of all siblings, level by level up to the root."""
    h = sha256()
    while link is not None:
        h.update(link.run[: link.slot * HEX])
        h.update(link.run[(link.slot + 1) * HEX :])
        link = link.above
    return h.hexdigest()


def folded(digest: str, link: Node | None) -> str:
    """The root that a foot digest gives together with its siblings."""
    while link is not None:
        h = sha256(link.run[: link.slot * HEX])
        h.update(digest.encode())
        h.update(link.run[(link.slot + 1) * HEX :])
        digest = h.hexdigest()
        link = link.above
    return digest


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Foot nodes in label order in, inner nodes out.

    A node's digest is sent ahead to its parent through a priority queue ordered by label; a parent is
    made as soon as the sweep has passed its last foot node. The queue holds fewer than 16 messages a level.
    """
    schema = pa.schema(
        [("tree", pa.string()), ("total", pa.int64()), ("unit", pa.int64()), ("end", pa.int64()), ("level", pa.int32())]
        + [("kids", pa.binary()), ("digest", pa.string()), ("top", pa.bool_())]
    )
    queue: list[tuple[int, int, int, str]] = []
    for batch in batches:
        out: list[tuple] = []
        for tree, total, idx, digest in zip(*(c.to_pylist() for c in batch.columns)):
            unit, foot = divmod(idx, SPAN)
            height, size = height_of(total), size_of(total, unit)
            if height == 0:
                out.append((tree, total, unit, foot, 0, None, digest, True))
                continue
            heapq.heappush(queue, (*label_of(1, foot // ARITY, size), foot % ARITY, digest))
            while queue and queue[0][0] <= foot:
                end, level = queue[0][:2]
                kids = []
                while queue and queue[0][:2] == (end, level):
                    kids.append(heapq.heappop(queue)[3])
                run = "".join(kids).encode()
                made = sha256(run).hexdigest()
                out.append((tree, total, unit, end, level, run, made, level == height))
                if level < height:
                    index = end // ARITY**level
                    heapq.heappush(queue, (*label_of(level + 1, index // ARITY, size), index % ARITY, made))
        columns = zip(*out) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def backward(batches: Iterator[pa.RecordBatch], foot: str) -> Iterator[pa.RecordBatch]:
    """Per unit its own proof, its inner nodes and its foot nodes, in reversed label order; foot nodes with proofs out.

    Each inner node takes its proof from the priority queue and sends a longer one back to its children.
    `foot` says what the foot nodes are: "documents", whose proofs are used up here (only digests
    leave the task), "groups", the roots of the documents' trees, or "units", the tops of lower units.
    """
    queue: list[tuple[int, int, Node | None]] = []
    subroot = None
    names = ("end", "level", "total", "unit", "body", "subroot", "digest")
    for batch in batches:
        feet, links, roots, leaves = [], [], [], []
        for n, (end, level, total, unit, body, own, digest) in enumerate(zip(*(batch.column(k).to_pylist() for k in names))):
            if end == _FIRST:
                subroot = own
                top, height = label_of(height_of(total), 0, size_of(total, unit))
                heapq.heappush(queue, (-top, -height, unpacked(body)))
                continue
            least_end, least_level, link = heapq.heappop(queue)
            if (-least_end, -least_level) != (end, level):
                raise ValueError(f"no proof reached node {end} of level {level}")
            if level == 0:
                feet.append(n)
                links.append(link)
                leaves.append(digest)
                roots.append(digest if foot == "groups" else subroot)
                continue
            index, size = end // ARITY**level, size_of(total, unit)
            for slot in range(len(body) // HEX):
                kid, below = label_of(level - 1, index * ARITY + slot, size)
                heapq.heappush(queue, (-kid, -below, Node(slot, body, link)))
        found = batch.take(pa.array(feet, pa.int64()))
        subroots = pa.array(roots, pa.string())
        if foot == "documents":
            copies = [copy or leaf for copy, leaf in zip(found.column("altered").to_pylist(), leaves)]
            more = [pa.array(map(proof, links), pa.string()), pa.array(map(folded, copies, links), pa.string())]
            columns = [found.column("doc_id"), found.column("digest"), subroots, *more]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])
        else:
            columns = [found.column("name"), found.column("idx"), pa.array(map(packed, links), pa.binary()), subroots]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "unit", "body", "subroot"])


def field(column: Column) -> Column:
    """`-` for null, else length in bytes, a colon, and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def record_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def rise(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Rounds from the foot up, (foot nodes, inner nodes) of each, and the roots of all trees.

    A round reduces up to SPAN nodes to one, so there are few: two for 16 million leaves, three for 68 billion.
    """
    rounds = []
    while True:
        labelled = nodes.withColumn("unit", F.expr(f"idx div {SPAN}"))
        swept = labelled.repartition("tree", "unit").sortWithinPartitions("tree", "idx").select("tree", "total", "idx", "digest")
        inner = through_table(swept.mapInArrow(forward, _INNER), "merkle-inner")
        rounds.append((labelled, inner))
        above = F.expr(f"(total + {SPAN - 1}) div {SPAN}")
        nodes = inner.filter("top").select("tree", above.alias("total"), F.col("unit").alias("idx"), "digest")
        if nodes.agg(F.max("total")).first()[0] in (None, 1):
            return rounds, nodes


def fall(rounds: list[tuple[DataFrame, DataFrame]], proofs: DataFrame, foot: str) -> DataFrame:
    """Proofs of all foot nodes of the lowest round, from those of the roots (`tree`, `unit`, `body`, `subroot`)."""
    text, blob = F.lit(None).cast("string"), F.lit(None).cast("binary")
    for number, (nodes, inner) in reversed(list(enumerate(rounds))):
        kind = "units" if number else foot
        heads = (
            nodes.filter(f"idx = unit * {SPAN}")
            .select("tree", "unit", "total")
            .join(proofs, ["tree", "unit"])
            .withColumns({"end": F.lit(_FIRST), "level": F.lit(99)})
        )
        middle = inner.filter("kids IS NOT NULL").select("tree", "unit", "total", "end", "level", F.col("kids").alias("body"))
        feet = nodes.withColumns({"end": F.expr(f"idx % {SPAN}"), "level": F.lit(0), "body": blob, "subroot": text})
        if kind == "units":
            feet = feet.withColumn("name", F.col("tree")).drop("doc_id", "altered")
        elif kind == "groups":
            feet = feet.withColumn("idx", F.lit(0).cast("long"))  # of a group's tree the only top unit
        stream = feet.unionByName(middle, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
        ordered = stream.repartition("tree", "unit").sortWithinPartitions("tree", "unit", F.desc("end"), F.desc("level"))
        schema = "tree string, unit long, body binary, subroot string"
        if kind == "documents":
            own = nodes.schema["doc_id"].dataType.simpleString()
            schema = f"doc_id {own}, leaf string, subroot string, proof_sha256 string, folded_root string"

        def sweep(batches: Iterator[pa.RecordBatch], kind: str = kind) -> Iterator[pa.RecordBatch]:
            return backward(batches, kind)

        proofs = ordered.mapInArrow(sweep, schema)
        if number:
            proofs = through_table(proofs, "merkle-proofs")
    return proofs


def manifest(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    group: str = "source",
    others: tuple[str, ...] = ("lang", "n_chars"),
    text: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """Merkle tree over all rows with a proof per row, and the check of each proof against a second copy of the rows.

    A row's leaf is the SHA-256 of its fields (key, group, others, text; null as `-`, else byte count, colon, value). Per
    group, leaves in order of the key form a tree in which 16 consecutive nodes make their parent; the groups' roots, in order of
    the groups (null first, bytewise), form the tree of the root. `tampered` says which rows' copies have the letters A to Z of
    the text in lower case; `folded_root` is what such a copy gives with the proof's siblings.

    Returns `doc_id`, `leaf`, `subroot`, `root`, `proof_sha256` (of the siblings up to the root), `folded_root` and `verified`.

    Leaves get their places by prefix sums over ranges of (group, key), so a hot group is spread over tasks. Trees are
    swept in units of 4,096 nodes in label order (`forward`); a unit's top goes to the next round by a shuffle, which takes the part of the
    external priority queue between tasks. `backward` sweeps the units in reversed order and hands proofs down. Texts are
    read once and never move.

    Null keys come first; rows with equal keys are ordered by leaf, and rows equal in all fields are interchangeable.
    A group of one row has its leaf as subroot; with one group the subroot is the root. Without any siblings the proof is the digest of
    nothing. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fields = [F.col(key), F.col(group), *map(F.col, others)]
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = tampered if tampered is not None else F.lit(False)
    thin = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        record_digest(*fields, F.col(text)).alias("digest"),
        F.when(changed, record_digest(*fields, lowered)).alias("altered"),
        F.monotonically_increasing_id().alias("tie"),
    )
    thin = through_table(thin, "merkle-leaves")
    leaves = numbered(thin, [F.col("doc_id"), F.col("digest"), F.col("tie")], ["tree"])
    leaves = through_table(leaves.withColumnRenamed("number", "idx").drop("tie"), "merkle-nodes")
    rounds, subroots = rise(leaves)

    subroots = through_table(subroots.select(F.col("tree").alias("name"), "digest"), "merkle-subroots")
    groups = numbered(subroots, [F.col("name")]).withColumnRenamed("number", "idx").withColumn("tree", F.lit(""))
    group_rounds, top = rise(through_table(groups, "merkle-groups"))
    found = top.first()
    root = F.lit(found["digest"] if found else None).cast("string")

    first = top.select("tree", F.col("idx").alias("unit"), F.lit(b"").alias("body"), F.lit(None).cast("string").alias("subroot"))
    proofs = fall(group_rounds, first, "groups")
    proofs = fall(rounds, through_table(proofs, "merkle-proofs"), "documents")
    return proofs.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
