"""Places of rows in an order over all partitions, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.sources.shared import through_table


def numbered(table: DataFrame, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """`table` with `number` (place from 0 by `order` among the rows with equal `within`) and `total` (how many those are).

    Rows are dealt to partitions by ranges of `within` and `order`, so a hot group is spread over many of
    them. Counts per partition give each partition's offset in each group by a prefix sum, and a row number
    inside the partition gives the place. `table` must be a written one (ranges are found by sampling it, and its
    rows must not change), `within` holds no nulls, and `order` must settle ties, also of repeated rows.
    """
    groups = list(within)
    ranged = table.repartitionByRange(*[F.col(c) for c in groups], *order)
    ranged = through_table(ranged.withColumn("__block", F.spark_partition_id()), "ordering")

    counts = ranged.groupBy("__block", *groups).agg(F.count("*").alias("__rows"))  # a row per partition and group in it
    group = Window.partitionBy(*groups)
    offsets = counts.select(
        "__block",
        *groups,
        F.coalesce(F.sum("__rows").over(group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__rows").over(group).alias("total"),
    )
    inside = Window.partitionBy("__block", *groups).orderBy(*order)
    placed = ranged.withColumn("__place", F.row_number().over(inside))
    return (
        placed.join(offsets, ["__block", *groups])
        .withColumn("number", F.col("__before") + F.col("__place") - 1)
        .drop("__block", "__before", "__place")
    )
