"""Materialised models and what the catalog knows about them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake.sources.bronze import LAYERS, create_layers


def materialize(
    df: DataFrame,
    layer: str,
    name: str,
    cluster_by: str | None = None,
    buckets: int | None = None,
    sort_by: str | None = None,
) -> DataFrame:
    """Rebuild ``layer.name`` as a physical table behind a view; the layer name is used verbatim.

    ``cluster_by`` and ``buckets`` bucket the table by a join key: joins between tables
    bucketed alike need no shuffle. Rows are brought together per bucket before the write,
    so that a bucket is not one file per task; the rebalance lets adaptive execution split
    a bucket that a hot key has made large over several tasks and files. ``sort_by`` sorts
    each file, so that filters on the column skip row groups.

    ``layer.name`` is a view of the newest version, a table of its own in `versions_of(layer)`. The new version is
    written and complete before one catalog call replaces the view, so a reader sees the old rows or the new ones, never none. A rebuild that fails
    leaves everything as it is. The version that the view showed before is kept for queries that already read it;
    older ones are dropped. There is to be one writer per name at a time. Returns the version that was written.
    """
    spark = df.sparkSession
    create_layers(spark, (layer, versions_of(layer)))
    if cluster_by and buckets:
        together = df.withColumn("_bucket", F.pmod(F.hash(cluster_by), F.lit(buckets)))
        df = together.hint("rebalance", F.col("_bucket")).drop("_bucket")
    rows = df.sortWithinPartitions(sort_by) if sort_by else df
    writer = rows.write.bucketBy(buckets, cluster_by) if cluster_by and buckets else rows.write
    before = versions(spark, layer, name)
    number = int(before[-1].rsplit("__", 1)[1]) + 1 if before else 1
    fresh = f"{name}__{number:09d}"
    try:
        writer.format("parquet").saveAsTable(f"{versions_of(layer)}.{fresh}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {versions_of(layer)}.{fresh}")
        raise
    publish(spark, layer, name, fresh)
    for old in before[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {versions_of(layer)}.{old}")
    return spark.table(f"{versions_of(layer)}.{fresh}")


def versions_of(layer: str) -> str:
    """The database that holds the versions of a layer's tables."""
    return f"{layer}_versions"


def versions(spark: SparkSession, layer: str, name: str) -> list[str]:
    """The versions of a table, oldest first."""
    if not spark.catalog.databaseExists(versions_of(layer)):
        return []
    found = (t.name for t in spark.catalog.listTables(versions_of(layer)))
    return sorted(t for t in found if re.fullmatch(re.escape(name.lower()) + r"__\d{9}", t))


def publish(spark: SparkSession, layer: str, name: str, version: str) -> None:
    """Shows a version as ``layer.name``, in one catalog call; also an older one that is still there.

    A plain table of that name, as earlier releases left it, is first renamed to a version; only then, once, the name is missing for a moment.
    """
    target = f"{layer}.{name}"
    if spark.catalog.tableExists(target) and spark.catalog.getTable(target).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {target} RENAME TO {layer}.{name}__000000000")
    spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {versions_of(layer)}.{version}")


def catalog_report(spark: SparkSession, layers: Iterable[str] = LAYERS, count_rows: bool = True) -> DataFrame:
    """Schema, table, number of columns and rows of every table in the layers."""
    known = {d.name for d in spark.catalog.listDatabases()}
    parts = []
    for layer in sorted(known & set(layers)):
        for table in sorted(spark.catalog.listTables(layer), key=lambda t: t.name):
            if table.isTemporary:
                continue
            df = spark.table(f"{layer}.{table.name}")
            rows = df if count_rows else df.limit(0)
            parts.append(
                rows.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(layer).alias("table_schema"),
                    F.lit(table.name).alias("table_name"),
                    F.lit(len(df.columns)).cast("long").alias("columns"),
                    "rows" if count_rows else F.lit(None).cast("long").alias("rows"),
                )
            )
    if not parts:
        return spark.createDataFrame([], "table_schema string, table_name string, columns long, rows long")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.orderBy("table_schema", "table_name")


def column_report(df: DataFrame) -> DataFrame:
    """Position, name and type of each column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def column_profile(df: DataFrame) -> DataFrame:
    """`column_report` with the number of rows and of values that are not NULL of each column, from one pass."""
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col("n").alias("rows"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def create_like(spark: SparkSession, table: str, copy: str) -> None:
    """An empty table of another name from the first one's definition: columns, types, partitions and properties."""
    ddl = table_ddl(spark, table)
    head, rest = ddl.split("(", 1)
    # the copy gets a place of its own
    rest = re.sub(r"\nLOCATION '[^']*'", "", rest)
    spark.sql(f"CREATE TABLE {copy} ({rest}")


def table_ddl(spark: SparkSession, table: str) -> str:
    return spark.sql(f"SHOW CREATE TABLE {table}").first()[0]
