"""Flat records as parquet between flattening and the bronze load, and their typing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fhirlake import schemas
from fhirlake.functions.dates import has_full_date
from fhirlake.sources.shared import path_exists, run_together, through_table


def record_path(folder: str, record: str) -> str:
    return f"{folder.rstrip('/')}/{record}.parquet"


def write_parsed(records: Mapping[str, DataFrame], folder: str) -> None:
    """One parquet set per record set; an empty one still carries its columns."""

    def write(record: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(record_path(folder, record))

    run_together([partial(write, record, df) for record, df in records.items()])


def check_inputs(spark: SparkSession, folder: str, records: Iterable[str] = tuple(schemas.RECORDS)) -> None:
    """All inputs must exist before the first load starts."""
    missing = [r for r in records if not path_exists(spark, record_path(folder, r))]
    if missing:
        raise FileNotFoundError(f"missing record sets in {folder}: {missing}")


def read_parsed(spark: SparkSession, folder: str, record: str) -> DataFrame:
    schema = schemas.parsed_schema(record)
    return spark.read.schema(schema).parquet(record_path(folder, record)).select(*schema.names)


def _is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampNTZType))


def _typed(df: DataFrame, field: T.StructField, strict: bool, tz: str | None) -> Column:
    source, kind = F.col(field.name), field.dataType
    if not isinstance(df.schema[field.name].dataType, T.StringType) or not _is_date(kind):
        return source.cast(kind) if strict else source.try_cast(kind)
    if strict:
        text = F.when(source.isNull() | has_full_date(source), source).otherwise(
            F.raise_error(F.concat(F.lit(f"{field.name}: not a full date: "), source))
        )
    else:
        text = F.when(has_full_date(source), source)

    def convert(kind_):
        return text.cast(kind_) if strict else text.try_cast(kind_)

    if tz is None or isinstance(kind, T.DateType):
        return convert(kind)
    # Through UTC and not through the session's wall clock, in which an autumn hour comes twice.
    micros = F.unix_micros(convert("timestamp"))
    utc = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def cast_to(df: DataFrame, schema: T.StructType, strict: bool = True, tz: str | None = None) -> DataFrame:
    """Type the columns of ``schema``.

    ``strict`` fails the job at the first value that does not convert; otherwise such
    values become NULL (see `rejected_rows`). Times keep their wall clock and drop the
    offset, unless ``tz`` names a zone to convert them to.
    """
    return df.select(*[_typed(df, f, strict, tz).alias(f.name) for f in schema.fields])


def rejected_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Source rows having a value that does not convert, with the names of those columns."""
    lost = [
        F.when(F.col(f.name).isNotNull() & _typed(df, f, False, None).isNull(), F.lit(f.name))
        for f in schema.fields
    ]
    return df.withColumn("rejected_columns", F.array_compact(F.array(*lost))).filter(
        F.size("rejected_columns") > 0
    )


REJECTED = "rejected"


@dataclass(frozen=True)
class Typed:
    """The typed rows of one record set and those that lost a value, read back from one table."""

    table: DataFrame
    columns: list[str]

    @property
    def rows(self) -> DataFrame:
        """All rows, typed; values that do not convert are NULL."""
        return self.table.select("typed.*")

    @property
    def rejected(self) -> DataFrame:
        """The rows with such a value as they came, and the names of those columns; reads their partition alone."""
        lost = self.table.filter(F.col(REJECTED))
        return lost.select("given.*", "rejected_columns").select(*self.columns, "rejected_columns")


def type_once(df: DataFrame, schema: T.StructType, tz: str | None = None) -> Typed:
    """`cast_to` without ``strict`` and `rejected_rows` from one scan and one conversion of each value.

    A row's typed form is written once, to the partition of the rows that lost a value or to that of all others; only
    the former also keep the form in which they came.
    """
    converted = df.select(
        F.struct("*").alias("given"), F.struct(*[_typed(df, f, False, tz).alias(f.name) for f in schema.fields]).alias("typed")
    )
    lost = F.array_compact(
        F.array(*[F.when(F.col("given")[f.name].isNotNull() & F.col("typed")[f.name].isNull(), F.lit(f.name)) for f in schema.fields])
    )
    marked = converted.withColumn("rejected_columns", lost).withColumn(REJECTED, F.size("rejected_columns") > 0)
    kept = marked.select("typed", F.when(F.col(REJECTED), F.col("given")).alias("given"), "rejected_columns", REJECTED)
    return Typed(through_table(kept, "typed", REJECTED), df.columns)
