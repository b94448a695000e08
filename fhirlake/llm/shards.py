"""Contiguous shards of near equal bytes, by prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.sources.shared import through_table

_ORDER = ["doc_id", "text_crc32", "size", "tie"]


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts the rows, ordered by key, into `shards` contiguous runs of near equal size.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). Rows are dealt to partitions by
    ranges of the key; totals per partition give each partition's offset by a prefix sum, a
    running sum inside the partition gives each row's place in the whole, and the row goes to
    the shard in whose equal share of all bytes its middle lies. A shard therefore differs from its share by
    no more than one row's size. Only keys, sizes and checksums move, never texts.

    Returns `doc_id`, `size`, `text_crc32` (of the UTF-8 bytes), `law` ("bytes"), `shard`, `slot` (place
    in the shard, from 0, in key order) and `grown_shard` (null: this law moves rows when a shard is added).

    Null keys come first. Rows with equal keys are ordered by checksum, then size; rows equal in all three
    are interchangeable and are split over partitions like others. Other columns are not read. An empty
    table gives no rows; with fewer rows than shards some shards stay empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    # Written first: ranges are found by sampling, which would otherwise read the texts twice, and
    # the tie-break must not change when a task is repeated.
    thin = through_table(thin.withColumn("tie", F.monotonically_increasing_id()), "shards")
    ranged = thin.repartitionByRange(*_ORDER).withColumn("block", F.spark_partition_id())
    ranged = through_table(ranged, "shards")

    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everywhere).alias("total"),
    )

    inside = Window.partitionBy("block").orderBy(*_ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.select("*", F.sum("size").over(running).alias("upto"), F.row_number().over(inside).alias("number"))
        .join(F.broadcast(offsets), "block")  # one row per partition
        .withColumn("number", F.col("rows_before") + F.col("number") - 1)
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(middle * {shards} div (2 * total) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("number") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
