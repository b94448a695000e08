"""The latest row per key as a table that is kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake.operators.dedupe import latest_by
from fhirlake.sources.shared import through_table

BUCKET = "_bucket"
#: A bucket of more rows is merged, and written, in several parts of about so many.
PART_ROWS = 1 << 20
_PART = "_bucket_part"


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.hash(*keys), F.lit(buckets)))


def create_latest(spark: SparkSession, table: str, schema_of: DataFrame, key: str | Sequence[str], buckets: int) -> None:
    """An empty table for `merge_latest`; an existing one is left alone.

    Key and number of buckets belong to the table and are kept in its properties. Choose the number so that a bucket of the grown
    table fits a task: a batch rewrites the buckets that it has keys of.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of.schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
        f"TBLPROPERTIES ('latest.key' = '{','.join(keys)}', 'latest.buckets' = '{buckets}')"
    )


def _properties(spark: SparkSession, table: str) -> tuple[list[str], int]:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found["latest.key"].split(","), int(found["latest.buckets"])


def merged(old: DataFrame, batch: DataFrame, key: Sequence[str], order: str, tiebreak: Sequence[str]) -> DataFrame:
    """The latest rows of both; of the batch only one row per key takes part in the shuffle with the old ones."""
    return latest_by(old.unionByName(latest_by(batch, key, order, tiebreak)), key, order, tiebreak)


def merge_latest(
    table: str, batch: DataFrame, order: str = "load_timestamp", tiebreak: Sequence[str] = ("load_batch_id",)
) -> list[int]:
    """Brings the batch's rows into the table; returns the buckets that were rewritten.

    Same rows as `latest_by` over all batches so far, in any order of the batches and however often one is repeated. It
    reads the batch and the buckets that have keys of it, and writes those alone. The merged rows are complete in the writer's staging
    folder before they replace the buckets, so a job that fails on the way leaves the table as it was; a repeated call mends buckets that a
    failure during the replacement left out.
    """
    spark = batch.sparkSession
    keys, buckets = _properties(spark, table)
    columns = [c for c in spark.table(table).columns if c != BUCKET]
    given = _bucketed(batch.select(*columns), keys, buckets)
    fresh = through_table(latest_by(given, [BUCKET, *keys], order, tiebreak), "latest-batch", compression="zstd")
    touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # numbers below `buckets`
    if not touched:
        return []
    old = spark.table(table).filter(F.col(BUCKET).isin(touched)).select(*columns, BUCKET)
    # Two rows of a key at most. They are dealt out once, by bucket and part of it, ranked there and written from there.
    parts = -(-(fresh.count() + old.count()) // (len(touched) * PART_ROWS))
    both = old.unionByName(fresh).withColumn(_PART, F.pmod(F.xxhash64(*keys), F.lit(parts)))
    rows = latest_by(both.repartition(BUCKET, _PART), [BUCKET, _PART, *keys], order, tiebreak)
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]
    # by path, where the mode is a setting of this write and not of the session
    writer = rows.select(*columns, BUCKET).write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd")
    writer.partitionBy(BUCKET).parquet(location)
    parts = " ".join(f"PARTITION ({BUCKET} = {n})" for n in touched)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
    spark.catalog.refreshTable(table)
    return touched


def latest(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(BUCKET)
