"""Exact top-k by inner product: threshold aggregation over sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.sources.shared import through_table

#: Distinct vectors whose sorted lists make a block, and queries that read a block together.
BLOCK = 2048
#: A block's lists are read in so many steps.
STEPS = 8
#: Reading for all stops when no more than this share of (query, vector) pairs may still qualify.
FEW = 1 / 64
#: Whole numbers up to here are exact in double precision.
_EXACT = 1 << 53


class Lists:
    """Sorted lists of one block: per component the vectors' places and values, largest value first.

    A query reads a list from the end where its weight makes the products large, so `read` goes on from both ends.
    `met_high` and `met_low` hold what was read from either end, and for the rest the far end of the list: the worst
    case of a positive and of a negative weight. `high` and `low` hold the best case, the last value read.
    """

    def __init__(self, places: np.ndarray, values: np.ndarray) -> None:
        self.places, self.values = places, values  # (components, vectors)
        self.rows = np.arange(len(values))[:, None]
        self.n = values.shape[1]
        self.at = 0
        self.met_high = np.repeat(values[:, -1:], self.n, 1)
        self.met_low = np.repeat(values[:, :1], self.n, 1)

    def read(self, upto: int) -> None:
        front, back = slice(self.at, upto), slice(self.n - upto, self.n - self.at)
        self.met_high[self.rows, self.places[:, front]] = self.values[:, front]
        self.met_low[self.rows, self.places[:, back]] = self.values[:, back]
        self.high = np.maximum(self.met_high, self.values[:, upto - 1 : upto])
        self.low = np.minimum(self.met_low, self.values[:, self.n - upto : self.n - upto + 1])
        self.at = upto

    def rest(self, wanted: np.ndarray) -> np.ndarray:
        """All components of some vectors, from the rest of the lists; what belongs to others is passed over."""
        row, column = np.nonzero(wanted[self.places[:, self.at :]])
        column += self.at
        self.met_high[row, self.places[row, column]] = self.values[row, column]
        return self.met_high[:, wanted]


def search(lists: Lists, weights: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of all pairs that may be among a query's k best, those that are certainly included.

    `least` is a score that each query's k-th best is known to reach. After each step a query's k-th largest lower bound
    may raise it. Vectors with an upper bound below it are out.
    """
    n = lists.n
    least = least.copy()
    signed = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], 1)
    for step in range(1, STEPS + 1):
        lists.read(max(1, n * step // STEPS))
        upper = signed @ np.concatenate([lists.high, lists.low])
        if n >= k:
            lower = signed @ np.concatenate([lists.met_high, lists.met_low])
            least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
        able = upper >= least[:, None]
        if np.count_nonzero(able) <= FEW * able.size:
            break
    wanted = able.any(0)
    scores = weights @ lists.rest(wanted)
    query, column = np.nonzero(able[:, wanted])
    return query, np.flatnonzero(wanted)[column], scores[query, column]


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    return np.array([x[:width] + [0] * (width - len(x)) for x in lists], np.int64).reshape(len(lists), width)


def sorted_lists(table: pa.Table) -> pa.Table:
    """One block's vectors as a list per component, and one more row (component -1) with the ids of each place."""
    vectors, ids = table.column("components").to_pylist(), table.column("ids").to_pylist()
    values = _matrix(vectors, max(map(len, vectors))).T
    order = np.argsort(-values, 1, kind="stable")
    places = [[len(x) for x in ids], *order]
    rows = [[i for x in ids for i in x], *np.take_along_axis(values, order, 1)]
    block = table.column("block")[0].as_py()
    return pa.table(
        {
            "block": pa.array([block] * len(rows), pa.int64()),
            "component": pa.array(range(-1, len(rows) - 1), pa.int32()),
            "places": pa.array(places, pa.list_(pa.int32())),
            "values": pa.array(rows, pa.list_(pa.int64())),
        }
    )


_FOUND = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.int64())])


def search_block(lists: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best vectors of a block for each query, equal scores by smallest id; those certainly not among its k best are left out."""
    if not lists.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    lists = lists.sort_by("component")
    flat, counts = lists.column("values")[0].values.to_numpy(), lists.column("places")[0].values.to_numpy()
    ends = np.cumsum(counts)
    width = lists.num_rows - 1
    if not width:  # vectors without components
        lists = lists.slice(0, 0)
        values = np.zeros((1, len(counts)), np.int64)
        places = np.arange(len(counts))[None, :]
        width = 1
    else:
        values = np.stack([x.values.to_numpy() for x in lists.column("values")[1:]])
        places = np.stack([x.values.to_numpy() for x in lists.column("places")[1:]])
    weights = _matrix(queries.column("components").to_pylist(), width)
    largest = int(np.abs(values.astype(object)).max()) * int(np.abs(weights.astype(object)).max()) * width
    kind = np.float64 if largest < _EXACT else object  # whole numbers of any size, slowly
    least = np.array([-np.inf if x is None else x for x in queries.column("least").to_pylist()], kind)
    query, place, score = search(Lists(places, values.astype(kind)), weights.astype(kind), least, k)
    own = (counts[place] == 1) & (flat[ends - counts][place] == queries.column("query_id").to_numpy()[query])
    query, place, score = query[~own], place[~own], score[~own]
    order = np.lexsort((flat[ends - counts][place], -score, query))
    query, place, score = query[order], place[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    query, place, score = (x[rank < k] for x in (query, place, score))
    return pa.table(
        {
            "asked": queries.column("asked").take(pa.array(query)),
            "query_id": queries.column("query_id").take(pa.array(query)),
            "ids": pa.array([flat[ends[p] - counts[p] : ends[p]] for p in place], pa.list_(pa.int64())),
            "score": pa.array([int(s) for s in score], pa.int64()),
        },
        schema=_FOUND,
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k rows of `vectors` with the largest inner product, exactly: `query_id`, `rank` (from 1), `vec_id`, `score`.

    Components are floor(scale * x), scores are whole numbers, ties go to the smaller id, and rows with the query's own id are left out.

    No random access: equal vectors are joined to one entry with their smallest ids, entries are dealt to blocks,
    and a block keeps one sorted list per component. A block of queries reads a block's lists from the ends step by step, keeps a lower and an upper bound for
    every vector, stops when few can still qualify, and reads on for those alone. Each query first reads one block in full search; its
    k-th score there is where all other blocks start, so they stop earlier and return little.

    Queries and vectors meet in blocks of at most about 2,048 each (an expected size, blocks are dealt by hash), so a
    task's memory is bounded whatever the tables' sizes.

    Vectors that are null, or hold nulls or non-finite components, and rows without id take no part, on either side. Rows that repeat id and
    vector count once. An id with several vectors takes part with each; as a query each has its own ranks. Shorter vectors are filled up with zeros.
    Fewer than k others: all are returned. An empty side gives no rows. Scaled components and scores must fit in 64 bits; a
    larger score is an error. Other columns are not read.
    """
    more = k + 1  # the query's own row may be among the best

    def prepared(df: DataFrame) -> DataFrame:
        fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
        kept = df.filter(F.col(key).isNotNull() & fine)
        return kept.select(F.col(key).cast("long").alias("id"), scaled.alias("components")).distinct()

    first = Window.partitionBy("components").orderBy("id")
    entries = prepared(vectors).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= more)
    entries = through_table(entries.groupBy("components").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-entries")
    asked = prepared(queries).withColumnRenamed("id", "query_id").withColumn("asked", F.monotonically_increasing_id())
    asked = through_table(asked, "topk-queries")
    blocks, parts = (max(1, -(-df.count() // BLOCK)) for df in (entries, asked))

    dealt = entries.withColumn("block", F.pmod(F.xxhash64("components"), F.lit(blocks)))
    lists = dealt.groupBy("block").applyInArrow(
        sorted_lists, "block long, component int, places array<int>, values array<long>"
    )
    lists = through_table(lists, "topk-lists").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    asked = asked.withColumns(
        {"part": F.pmod(F.xxhash64("asked"), F.lit(parts)), "home": F.pmod(F.xxhash64(F.lit(1), "asked"), F.lit(blocks))}
    )

    def answers(turn: DataFrame) -> DataFrame:
        both = lists.groupBy("block", "part").cogroup(turn.groupBy("block", "part"))
        return both.applyInArrow(
            lambda a, b: search_block(a, b, more), "asked long, query_id long, ids array<long>, score long"
        )

    at_home = asked.withColumn("block", F.col("home")).withColumn("least", F.lit(None).cast("long"))
    found = through_table(answers(at_home), "topk-home")
    least = found.groupBy("asked").agg(F.when(F.count("*") >= more, F.min("score")).alias("least"))
    away = asked.join(least, "asked", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    found = found.unionByName(answers(away.filter("block <> home")))

    each = found.select("asked", "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
