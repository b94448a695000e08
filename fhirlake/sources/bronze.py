"""Bronze tables: raw typed rows with audit columns, partitioned by load batch."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.sources.parsed import Typed, cast_to, check_inputs, read_parsed, record_path, type_once
from fhirlake.sources.shared import run_together

BRONZE = "bronze"
# Layer names and the batch label format.
LAYERS = ("bronze", "silver", "gold")
BATCH_FORMAT = "%Y-%m-%d_%H-%M-%S"


def bronze_name(record: str, database: str = BRONZE) -> str:
    return f"{database}.bronze_{record}"


def create_layers(spark: SparkSession, layers: tuple[str, ...] = LAYERS, location: str | None = None) -> None:
    for layer in layers:
        at = f" LOCATION '{location.rstrip('/')}/{layer}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}{at}")


def create_bronze(spark: SparkSession, database: str = BRONZE, location: str | None = None) -> None:
    """Database and five typed tables; existing ones are left alone."""
    create_layers(spark, (database,), location)
    for record in schemas.RECORDS:
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in schemas.bronze_schema(record).fields
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {bronze_name(record, database)} ({columns}) "
            "USING parquet PARTITIONED BY (load_batch_id)"
        )


def new_batch_id(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now()).strftime(BATCH_FORMAT)


def stamp_audit(df: DataFrame, batch_id: str, ts: dt.datetime | None = None) -> DataFrame:
    """Same load time and batch label on every row of one load."""
    now = F.current_timestamp() if ts is None else F.lit(ts.isoformat(sep=" "))
    return df.withColumn("load_timestamp", now.cast("timestamp_ntz")).withColumn(
        "load_batch_id", F.lit(batch_id)
    )


def _insert(rows: DataFrame, table: str, batch_id: str, overwrite: bool) -> None:
    """Into the partition of one batch: a static partition needs no sort before the write."""
    if not re.fullmatch(r"[\w.:-]+", batch_id):
        raise ValueError(f"unusable batch id {batch_id!r}")
    how = "OVERWRITE" if overwrite else "INTO"
    spark = rows.sparkSession
    wanted = [c for c in spark.table(table).columns if c != "load_batch_id"]
    if sorted(wanted) != sorted(c for c in rows.columns if c != "load_batch_id"):
        raise ValueError(f"{table} has columns {wanted}, the load has {rows.columns}")
    spark.sql(
        f"INSERT {how} TABLE {table} PARTITION (load_batch_id = '{batch_id}') SELECT * FROM {{rows}}",
        rows=rows.select(*wanted),
    )


def drop_other_batches(spark: SparkSession, table: str, batch_id: str) -> None:
    names = [unquote(p[0].removeprefix("load_batch_id=")) for p in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    others = ", ".join(f"PARTITION (load_batch_id = '{n}')" for n in names if n != batch_id)
    if others:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {others}")


def load_bronze(
    df: DataFrame | Typed,
    record: str,
    mode: str = "replace",
    batch_id: str | None = None,
    ts: dt.datetime | None = None,
    strict: bool = True,
    tz: str | None = None,
    database: str = BRONZE,
) -> str:
    """Type, stamp and load one record set; returns the batch id.

    ``append`` keeps all history. ``rerun`` writes this batch afresh and keeps the others,
    so that a repeated load does not double its rows. ``replace`` leaves only this batch;
    older ones go after the new rows are in and counted, so a load that fails loses nothing.

    ``df`` holds parsed rows, or rows that are typed already (see `parsed.type_once`).
    """
    if mode not in ("replace", "append", "rerun"):
        raise ValueError(f"unknown mode {mode!r}")
    batch_id = batch_id or new_batch_id()
    table = bronze_name(record, database)
    typed = df.rows if isinstance(df, Typed) else cast_to(df, schemas.RECORDS[record], strict, tz)
    source_rows = df.rows if isinstance(df, Typed) else df
    spark = typed.sparkSession
    _insert(stamp_audit(typed, batch_id, ts), table, batch_id, overwrite=mode != "append")
    if mode == "replace":
        reconcile(source_rows, spark.table(table), batch_id)
        drop_other_batches(spark, table, batch_id)
    return batch_id


class LoadMismatch(RuntimeError):
    """A batch holds other than the number of rows of its source."""


def batch_counts(source: DataFrame, table: DataFrame, batch_id: str) -> DataFrame:
    """(source_rows, loaded_rows, status) of one batch."""
    loaded = table.filter(F.col("load_batch_id") == batch_id)
    counts = source.agg(F.count(F.lit(1)).alias("source_rows")).join(
        loaded.agg(F.count(F.lit(1)).alias("loaded_rows"))
    )
    same = F.col("source_rows") == F.col("loaded_rows")
    return counts.withColumn("status", F.when(same, "OK").otherwise("MISMATCH"))


def content(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest) of a table's rows, whatever their order.

    The digest is two sums of 64-bit hashes per row, so that a row counts as often as it occurs. Nulls are told apart by
    place, which the hash function alone does not do.
    """
    fields = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *fields).cast("decimal(38,0)")), F.lit(0)) for seed in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *(s.cast("string") for s in sums)).alias("digest"))


def batch_content(source: DataFrame, table: DataFrame, batch_id: str) -> DataFrame:
    """(source_rows, loaded_rows, status) of one batch, by rows and content; ``source`` is typed, without audit columns.

    Other than by `batch_counts`, a lost row that a doubled one makes up for is a MISMATCH.
    """
    columns = [c for c in table.columns if c not in schemas.AUDIT.names]
    loaded = table.filter(F.col("load_batch_id") == batch_id)
    both = content(source, columns).select(F.col("rows").alias("source_rows"), F.col("digest").alias("given")).join(
        content(loaded, columns).select(F.col("rows").alias("loaded_rows"), F.col("digest").alias("found"))
    )
    same = (F.col("source_rows") == F.col("loaded_rows")) & (F.col("given") == F.col("found"))
    return both.select("source_rows", "loaded_rows", F.when(same, "OK").otherwise("MISMATCH").alias("status"))


def load_report(pairs: dict[str, tuple[DataFrame, DataFrame]], batch_id: str) -> DataFrame:
    """(table_name, source_rows, loaded_rows, status) of one batch, a row for each (source, table)."""
    parts = [batch_counts(*pair, batch_id).select(F.lit(name).alias("table_name"), "*") for name, pair in pairs.items()]
    return reduce(DataFrame.unionByName, parts)


def reconcile(source: DataFrame, table: DataFrame, batch_id: str, by_content: bool = False) -> tuple[int, int]:
    row = (batch_content if by_content else batch_counts)(source, table, batch_id).first()
    if row.status != "OK":
        raise LoadMismatch(f"batch {batch_id}: source {row.source_rows}, loaded {row.loaded_rows}")
    return row.source_rows, row.loaded_rows


def load_all(
    spark: SparkSession,
    folder: str,
    mode: str = "replace",
    batch_id: str | None = None,
    ts: dt.datetime | None = None,
    strict: bool = True,
    tz: str | None = None,
    database: str = BRONZE,
    by_content: bool = False,
) -> str:
    """Load all five parsed record sets as one batch and reconcile each; see `load_report` for the counts.

    With ``strict=False`` rows that hold an unloadable value are also kept as they came, with the names
    of the columns, in ``rejected/<record>.parquet`` of the folder; the input is then read and converted once for both.
    ``by_content`` reconciles the rows themselves instead of their number.
    """
    check_inputs(spark, folder)
    create_bronze(spark, database)
    batch_id = batch_id or new_batch_id()

    def load(record: str) -> None:
        parsed = read_parsed(spark, folder, record)
        given, rows = parsed, parsed
        if not strict:
            given = type_once(parsed, schemas.RECORDS[record], tz)
            rows = given.rows
            given.rejected.write.mode("overwrite").parquet(record_path(f"{folder.rstrip('/')}/rejected", record))
        load_bronze(given, record, mode, batch_id, ts, strict, tz, database)
        if by_content and strict:
            rows = cast_to(parsed, schemas.RECORDS[record], strict, tz)
        reconcile(rows, source(spark, record, database), batch_id, by_content)

    run_together([partial(load, record) for record in schemas.RECORDS])
    return batch_id


def source(spark: SparkSession, record: str, database: str = BRONZE) -> DataFrame:
    """Bronze rows of a record set by its logical name."""
    if record not in schemas.RECORDS:
        raise KeyError(f"unknown source {record!r}; known: {sorted(schemas.RECORDS)}")
    return spark.table(bronze_name(record, database))


def bronze_state(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct batches per table."""
    parts = []
    for name, df in tables.items():
        per_batch = df.groupBy("load_batch_id").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_batch.agg(
                F.lit(name).alias("table_name"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.count("load_batch_id").alias("batches"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
