"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.llm.sampling import drawn
from fhirlake.sources.shared import through_table

#: Bounded sample from which pivots are drawn; every row is indexed.
PIVOTS = 2_048
#: A vector is posted under so many of its nearest pivots, and a query opens as many lists.
NEAREST = 96
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
#: Share of a block's distinct vectors that is reranked, and the least number of them for each wanted neighbour.
RERANK_SHARE, RERANK_EACH = 0.12, 16
#: Distances to the pivots are computed for so many vectors at a time.
ROWS_AT_A_TIME = 512


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v, norm) of the rows that take part; v keeps its type, the norm is double."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine).withColumn("norm", norm)
    return rows.filter("norm > 0").distinct()


def choose_pivots(rows: DataFrame, count: int, longest: float, total: int) -> np.ndarray:
    """`count` distinct lifted vectors, from a sample of twice as many rows drawn by hash.

    They follow the rows: where many lie close together there are many pivots, which tell them apart. Vectors elsewhere
    are not posted under those.
    """
    sample = drawn(rows.select("id", "v"), 2 * count, total, "id", "v").collect()
    lifted = lift(np.array([r["v"] for r in sample], dtype=np.float64), longest)
    _, first = np.unique(lifted, axis=0, return_index=True)
    return lifted[np.sort(first)][:count]


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """With one more coordinate all vectors are of equal length, and inner products order them as angles do."""
    room = np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0.0)
    return np.hstack([x, np.sqrt(room)[:, None]]) / longest


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """For each lifted vector its nearest pivots, in order."""
    count = min(count, len(pivots))
    out = np.empty((len(x), count), np.int16)
    for first in range(0, len(x), ROWS_AT_A_TIME):
        near = -(x[first : first + ROWS_AT_A_TIME] @ pivots.T)
        some = np.argpartition(near, count - 1, axis=1)[:, :count]
        some.sort(axis=1)
        order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[first : first + ROWS_AT_A_TIME] = np.take_along_axis(some, order, axis=1)
    return out


def represented(rows: DataFrame, pivots: np.ndarray, count: int, longest: float, flat: bool) -> DataFrame:
    """(id, v) with `near`, the numbers of the nearest pivots in order (16 bits each). Queries are laid `flat`, at their own length."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                lifted = np.hstack([x, np.zeros((len(x), 1))]) if flat else lift(x, longest)
                found = nearest_pivots(lifted, pivots, count).astype("<i2")
                near = pa.array([row.tobytes() for row in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, near], ["id", "v", "near"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(describe, f"id long, v {kind}, near binary")


def lists_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<i2").reshape(len(column), -1)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Files:
    """Pivot inverted files of one block: under each pivot the vectors that have it among their nearest, with its place there."""

    def __init__(self, near: np.ndarray, pivots: int) -> None:
        self.n, self.m = near.shape
        flat = near.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.vectors = (order // self.m).astype(np.int32)
        self.places = (order % self.m).astype(np.int32)
        self.starts = np.searchsorted(flat[order], np.arange(pivots + 1))

    def ranked(self, own: np.ndarray, count: int) -> np.ndarray:
        """The `count` vectors with the least footrule distance to a query's list; only its own pivots' files are opened.

        A pivot that is missing in a list stands right after its end. Then each pivot that two lists share takes
        twice the room behind the later of its two places off the distance of lists that share none.
        """
        starts, sizes = self.starts[own], self.starts[own + 1] - self.starts[own]
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        place = np.repeat(np.arange(len(own)), sizes)
        closer = np.bincount(self.vectors[at], weights=self.m - np.maximum(place, self.places[at]), minlength=self.n)
        # equal distances by place, so that a repeated task takes the same ones
        key = np.arange(self.n) - closer.astype(np.int64) * self.n
        return np.argpartition(key, count - 1)[:count] if count < self.n else np.arange(self.n)


def search_cell(pivots: int, k: int, share: float, each: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Searches one block of the index for one block of queries."""

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(queries):
            ids, x = index["id"].to_numpy(), matrix(index["v"])
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            # Copies of a vector share a place in the index. Their k + 1 smallest ids can win, the others cannot:
            # equal scores go to smaller ids, and a query leaves out one id.
            _, first, copy_of = np.unique(x, axis=0, return_index=True, return_inverse=True)
            by_first = np.argsort(first)
            rank = np.empty(len(first), np.int64)
            rank[by_first] = np.arange(len(first))
            copy_of = rank[copy_of.reshape(-1)]
            distinct = x[first[by_first]]
            members = np.argsort(copy_of, kind="stable")
            begins = np.searchsorted(copy_of[members], np.arange(len(distinct) + 1))

            files = Files(lists_of(index["near"])[by_id][first[by_first]], pivots)
            count = min(len(distinct), max(each * k, int(share * len(distinct))))
            query_ids, q, lists = queries["id"].to_numpy(), matrix(queries["v"]), lists_of(queries["near"])
            for query, vector, own_list in zip(query_ids, q, lists):
                near = files.ranked(own_list, count)
                score = distinct[near] @ vector
                if len(near) > k + 1:  # the query's own vector may be among them
                    bound = -np.partition(-score, k)[k]
                    near, score = near[score >= bound], score[score >= bound]
                found = [(members[begins[m] : begins[m + 1]][: k + 1], s) for m, s in zip(near, score)]
                own = np.concatenate([ids[m] for m, _ in found])
                value = np.repeat([s for _, s in found], [len(m) for m, _ in found])
                own, value = own[own != query], value[own != query]
                best = np.lexsort((own, -value))[:k]
                out.append((np.full(len(best), query), own[best], value[best]))
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        return pa.table(
            {
                "query_id": pa.array(query_id, pa.int64()),
                "vec_id": pa.array(vec_id, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return search


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    nearest_count: int = NEAREST,
    block_rows: int = BLOCK_ROWS,
    rerank_share: float = RERANK_SHARE,
    rerank_each: int = RERANK_EACH,
) -> DataFrame:
    """For each query row its `k` nearest other rows by inner product: query_id, rank, vec_id, score.

    A vector is represented by its `nearest_count` nearest pivots in order, of `pivots` drawn from a bounded sample. The rows are dealt to blocks of
    about `block_rows`, each with its own inverted files (under every pivot the vectors that have it in their lists, and where). Blocks of queries visit
    all blocks of the index; in a cell a query opens the files of its own nearest pivots alone, vectors are ranked by the footrule
    distance of the lists, and the best `rerank_share` of the block (at least `rerank_each` for each of the `k`) are
    ranked by the inner product in double precision. The best `k` of all blocks are kept, ties to the smaller id. Tables of any size
    take this path.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null
    id or vectors whose length is not the most frequent one. Rows equal in id and vector count once; rows that
    share the query's id are never its neighbours. Copies of one vector are ranked as one. With fewer
    candidates than `k` all are returned; without queries or candidates there are no rows.
    """
    rows = through_table(usable(vectors, key, vector), "neighbours")
    facts = (
        rows.groupBy(F.size("v").alias("width"))
        .agg(F.count("*").alias("rows"), F.max("norm").alias("longest"))
        .orderBy(F.desc("rows"), "width")
        .first()
    )
    schema = "query_id long, vec_id long, score double"
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == facts["width"])
    asked = usable(queries, key, vector).filter(F.size("v") == facts["width"]).select("id", "v")
    blocks = -(-facts["rows"] // block_rows)
    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(n)).cast("int")

    chosen = choose_pivots(rows, pivots, facts["longest"], facts["rows"])

    def posted(df: DataFrame, flat: bool) -> DataFrame:
        """Written: every cell reads it, and pivots are not to be ranked again for each."""
        return through_table(represented(df, chosen, nearest_count, facts["longest"], flat), "neighbours-posted")

    index = posted(rows, False).withColumn("block", dealt(blocks)).withColumn("query_block", every(query_blocks))
    asked = posted(asked, True).withColumn("query_block", dealt(query_blocks)).withColumn("block", every(blocks))
    cell = ["block", "query_block"]
    search = search_cell(len(chosen), k, rerank_share, rerank_each)
    found = index.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(
        lambda left, right: search(left, right), schema
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
