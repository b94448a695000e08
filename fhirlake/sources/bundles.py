"""Patient bundles: one JSON document per file, decoded and unnested as Spark rows.

A decoded bundle is ``(bundle_id, value, entry, bad, raw)``; ``bad`` marks documents that
are not readable as a bundle, ``raw`` holds the bytes of those that are not UTF-8. They are set
aside, never allowed to stop a run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fhirlake import schemas
from fhirlake.functions.paths import normalize_ref
from fhirlake.sources.shared import shared_dir

# Files of the export folder that are not patient bundles.
FILE_PATTERN = "*.json"
SKIPPED_PREFIXES = ("hospitalInformation", "practitionerInformation")
UNKNOWN_TYPE = "Unknown"

_ENTRY = "pos:int,full_url:string,resource_type:string,resource:string,linked:string"

# Partition of a staged ingest that holds one row per bundle instead of resources.
BUNDLE_ROW = "_bundle"
# Partition of a staged ingest that holds one row per bundle and resource type that was not kept.
DROPPED_ROW = "_dropped"


def is_patient_file(name):
    wanted = F.lit(True)
    for prefix in SKIPPED_PREFIXES:
        wanted = wanted & ~name.startswith(prefix)
    return wanted


def _contents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", FILE_PATTERN).load(path)


def file_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Patient files of the folder(s) as ``(bundle_id, name, length)``, from metadata alone.

    Spark's file sources leave out files without a byte when they read. The listing has them, so what is
    listed and not read is such a file (length 0). As for any file scan, the listing lies on the driver.
    """
    found = _contents(spark, path)
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "file string")
    # the listing writes an empty authority, file metadata do not
    listed = listed.select(F.regexp_replace("file", "^([^:/]+):///", "$1:/").alias("bundle_id"))
    read = found.select(F.col("_metadata.file_path").alias("bundle_id"), "length")
    last = F.replace(F.element_at(F.split("bundle_id", "/"), -1), F.lit("+"), F.lit("%2B"))
    index = listed.join(read, "bundle_id", "left").select(
        "bundle_id", F.url_decode(last).alias("name"), F.coalesce("length", F.lit(0)).alias("length")
    )
    return index.filter(is_patient_file(F.col("name")))


def read_bundles(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Bundle files of the folder(s) as ``(bundle_id, value)``, the value as bytes; optionally the first n by name.

    The id is the file's path, so that files of one name in several folders stay apart; equal names
    are ordered by path. Files without a byte have an empty value. Only the file at the cut reaches the driver: files are
    listed without reading their contents, and the cut is then a filter on file metadata, which prunes the listing.
    """
    index = file_index(spark, path)
    docs = _contents(spark, path).select(
        F.col("_metadata.file_path").alias("bundle_id"), F.col("_metadata.file_name").alias("name"), F.col("content").alias("value")
    )
    docs = docs.filter(is_patient_file(F.col("name")))
    empty = index.filter("length = 0").select("bundle_id", "name", F.lit(b"").alias("value"))
    if limit is not None:
        cut = index.orderBy("name", "bundle_id").limit(limit).agg(F.max(F.struct("name", "bundle_id"))).first()[0]
        kept = F.lit(False)
        if cut is not None:
            kept = (F.col("name") < cut["name"]) | ((F.col("name") == cut["name"]) & (F.col("bundle_id") <= cut["bundle_id"]))
        docs, empty = docs.filter(kept), empty.filter(kept)
    return docs.unionByName(empty).select("bundle_id", "value")


def require_bundles(bundles: DataFrame) -> DataFrame:
    if bundles.isEmpty():
        raise ValueError("no patient bundles found")
    return bundles


def _is_binary(bundles: DataFrame) -> bool:
    return isinstance(bundles.schema["value"].dataType, T.BinaryType)


def decode_bundles(bundles: DataFrame) -> DataFrame:
    """Parse the envelope only; each resource stays JSON text.

    Values given as bytes must be UTF-8: a document with another byte is bad, and its bytes stay in ``raw``. Values
    given as text are taken as they are.
    """
    text, raw = F.col("value"), F.lit(None).cast("binary")
    if _is_binary(bundles):
        text = F.col("value").cast("string")
        raw = F.when(~F.is_valid_utf8(text), F.col("value"))
        text = F.when(F.is_valid_utf8(text), text).otherwise(F.make_valid_utf8(text))
    bundles = bundles.select("bundle_id", text.alias("value"), raw.alias("raw"))
    # Wrapped in a document of our own, so that the decoder reads the text to its end: anything
    # after the bundle, also a second bundle, breaks the wrapper or hides its last field.
    wrapped = F.concat(F.lit('{"d":'), F.col("value"), F.lit('\n,"_end":1}'))
    decoded = bundles.select(
        "bundle_id",
        "value",
        "raw",
        F.from_json(
            wrapped,
            f"d struct<{schemas.BUNDLE_FIELDS}>, _end int, _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ).alias("doc"),
    )
    whole = F.col("doc.d").isNotNull() & (F.col("doc._end") == 1) & F.col("doc._corrupt").isNull() & F.col("raw").isNull()
    return decoded.select(
        "bundle_id",
        "value",
        F.col("doc.d.entry").alias("entry"),
        (~F.coalesce(whole, F.lit(False))).alias("bad"),
        "raw",
    )


NOT_UTF8 = "not UTF-8"


def _reason() -> Column:
    """Class of the error: bytes, an empty file, text after a readable document, or a document that is not readable as a bundle."""
    # The first document in the text, and the text as a single one: different only if something follows.
    first = F.get_json_object("value", "$").isNotNull()
    whole = F.try_parse_json(F.concat(F.lit('{"d":'), F.col("value"), F.lit("}"))).isNotNull()
    return (
        F.when(F.col("raw").isNotNull(), NOT_UTF8)
        .when(F.col("value") == "", "empty file")
        .when(~F.ltrim("value").startswith("{"), "not a JSON object")
        .when(first & ~whole, "text after the document")
        .otherwise("malformed document")
    )


def failure_messages(quarantined: DataFrame) -> DataFrame:
    """The quarantine with ``message``: what the standard JSON parser says about each document, and where.

    A Python helper on the documents set aside alone. Documents that it can read get a NULL (they are JSON, but no bundle).
    """

    def explain(document: bytes) -> str | None:
        try:
            read = json.loads(document.decode("utf-8"))
        except (ValueError, RecursionError) as error:
            return f"{type(error).__name__}: {error}"
        return None if isinstance(read, dict) else f"TypeError: a bundle must be an object, not {type(read).__name__}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):  # a document at a time: their sizes are not bounded
                row = batch.slice(n, 1)
                message = explain(row.column("_bytes")[0].as_py() or b"")
                kept = row.select([c for c in row.schema.names if c != "_bytes"])
                yield kept.append_column("message", pa.array([message], pa.string()))

    given = F.coalesce("raw", F.col("value").cast("binary"))
    fields = T.StructType([*quarantined.schema.fields, T.StructField("message", T.StringType())])
    return quarantined.withColumn("_bytes", given).mapInArrow(rows, fields)


def quarantine(decoded: DataFrame) -> DataFrame:
    """Unreadable documents with a reason, their whole text and, where that is not UTF-8, their bytes, for repair and replay."""
    # Unnesting instead of filtering: a filter would be pushed below the decoding and repeat it.
    row = F.struct("bundle_id", _reason().alias("reason"), "value", "raw")
    return decoded.select(F.inline(F.when(F.col("bad"), F.array(row))))


def split_bad_bundles(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantine). Prefer `stage_bundles` for large input: it reads the files once."""
    decoded = decode_bundles(bundles)
    row = F.struct("bundle_id", "value", "entry", "bad")
    readable = decoded.select(F.inline(F.when(~F.col("bad"), F.array(row))))
    return readable, quarantine(decoded)


def _unnested(decoded: DataFrame, *others: Column) -> DataFrame:
    """``(bundle_id, *others, all)``: the entries of each bundle as one array, no row of it moved.

    A medication request that refers to a medication of its own bundle carries that resource as ``linked``; of several with
    one id the last wins. Both lie in the same document, so the reference is followed inside its row.
    """
    entries = F.transform(
        F.when(~F.col("bad"), F.col("entry")),
        lambda e, i: F.struct(
            i.alias("pos"),
            e["fullUrl"].alias("full_url"),
            F.get_json_object(e["resource"], "$.resourceType").alias("resource_type"),
            e["resource"].alias("resource"),
            F.lit(None).cast("string").alias("linked"),
        ),
    )
    none = F.array().cast(f"array<struct<{_ENTRY}>>")
    rows = decoded.select("bundle_id", *others, F.coalesce(entries, none).alias("entries"))
    medications = F.transform(
        F.filter("entries", lambda r: r["resource_type"] == "Medication"),
        lambda r: F.struct(F.get_json_object(r["resource"], "$.id").alias("id"), r["resource"].alias("resource")),
    )
    named = F.filter(medications, lambda m: m["id"] != "")
    rows = rows.select("*", named.alias("medications"))

    def linked(r: Column) -> Column:
        wanted = normalize_ref(F.get_json_object(r["resource"], "$.medicationReference.reference"))
        same = F.filter("medications", lambda m: m["id"] == wanted)
        return F.try_element_at(same, F.lit(-1))["resource"]

    with_links = F.transform(
        "entries", lambda r: r.withField("linked", F.when(r["resource_type"] == "MedicationRequest", linked(r)))
    )
    every = F.when(F.size("medications") > 0, with_links).otherwise(F.col("entries"))
    return rows.withColumn("all", every).drop("entries", "medications")


def explode_entries(decoded: DataFrame) -> DataFrame:
    """Every entry of every readable bundle, also those without a resource."""
    # An expression and not the column itself, for which the optimizer would add a filter and push it below the decoding.
    every = F.filter("all", lambda r: r["pos"] >= 0)
    return _unnested(decoded).select("bundle_id", F.inline(every))


def explode_resources(decoded: DataFrame) -> DataFrame:
    return explode_entries(decoded).filter(F.col("resource").isNotNull())


def resource_type_counts(entries: DataFrame | Staged, per_bundle: bool = False) -> DataFrame:
    """Entries per resource type, a missing type counting as Unknown.

    On a `Staged` this reads no document text, only the partitions' row counts and the counts of the
    types that were not kept.
    """
    keys = (["bundle_id"] if per_bundle else []) + ["resource_type"]
    if isinstance(entries, Staged):
        rows, n = entries.counted, F.sum("n")
    else:
        rows, n = entries, F.count(F.lit(1))
    named = rows.withColumn("resource_type", F.coalesce("resource_type", F.lit(UNKNOWN_TYPE)))
    return named.groupBy(*keys).agg(n.alias("n"))


def resource_type_totals(entries: DataFrame | Staged) -> DataFrame:
    """Entries in total and number of distinct resource types."""
    return resource_type_counts(entries).agg(
        F.sum("n").alias("entries"), F.count(F.lit(1)).alias("resource_types")
    )


@dataclass(frozen=True)
class Staged:
    """Resources and bundle rows of one ingest, read back from the staging table.

    ``metrics`` was observed while that table was written: documents (`bundles_ok`, `bundles_failed`) and entries
    (`entries`, of which `entries_kept` and `entries_dropped`).
    """

    table: DataFrame
    metrics: dict[str, int] = field(default_factory=dict)

    @property
    def entries(self) -> DataFrame:
        """All kept entries, also those without a resource."""
        kind = F.col("resource_type")
        return self.table.filter(kind.isNull() | ~kind.isin(BUNDLE_ROW, DROPPED_ROW))

    @property
    def counted(self) -> DataFrame:
        """``(bundle_id, resource_type, n)``: a row per kept entry, and one per bundle and type that was not kept."""
        kept = self.entries.select("bundle_id", "resource_type", F.lit(1).cast("long").alias("n"))
        dropped = self.table.filter(F.col("resource_type") == DROPPED_ROW)
        return kept.unionByName(
            dropped.select("bundle_id", F.col("full_url").alias("resource_type"), F.col("pos").cast("long").alias("n"))
        )

    @property
    def resources(self) -> DataFrame:
        return self.entries.filter(F.col("resource").isNotNull())

    @property
    def bundles(self) -> DataFrame:
        return self.table.filter(F.col("resource_type") == BUNDLE_ROW).select(
            "bundle_id", (F.col("pos") < 0).alias("failed"), F.col("full_url").alias("reason")
        )

    @property
    def quarantine(self) -> DataFrame:
        failed = self.table.filter((F.col("resource_type") == BUNDLE_ROW) & (F.col("pos") < 0))
        rows = failed.select("bundle_id", F.col("full_url").alias("reason"), "resource")
        raw = F.when(F.col("reason") == NOT_UTF8, F.unbase64("resource"))
        return rows.select(
            "bundle_id",
            "reason",
            F.when(raw.isNull(), F.col("resource")).otherwise(F.make_valid_utf8(raw.cast("string"))).alias("value"),
            raw.alias("raw"),
        )


def _dropped_counts(entries: Column, types: Sequence[str]) -> Column:
    """A row per type that is not kept: how many entries of it the document has (as ``pos``) and its name."""
    others = F.transform(
        F.filter(entries, lambda r: ~F.coalesce(r["resource_type"].isin(*types), F.lit(False))),
        lambda r: F.coalesce(r["resource_type"], F.lit(UNKNOWN_TYPE)),
    )
    return F.transform(
        F.array_distinct(others),
        lambda t: F.struct(
            F.size(F.filter(others, lambda o: o == t)).alias("pos"),
            t.alias("full_url"),
            F.lit(DROPPED_ROW).alias("resource_type"),
            F.lit(None).cast("string").alias("resource"),
            F.lit(None).cast("string").alias("linked"),
        ),
    )


def stage_bundles(
    bundles: DataFrame, path: str | None = None, types: Sequence[str] | None = None
) -> Staged:
    """Read and unnest the documents once into a table partitioned by resource type.

    The five flatteners, the quarantine and the run counts then each read only their own
    partition. Bundle rows carry ``pos`` -1 and the whole text for an unreadable document (its bytes in base64 if it
    is not UTF-8), 0 for a readable one. ``types`` names the resource types to keep; the flatteners use
    six of the twenty or so in a bundle, so the rest need not be written for them. Of the others one count per
    bundle and type is written. The run's totals are observed by the same write.
    """
    spark = bundles.sparkSession
    path = path or shared_dir(spark, "resources")
    decoded = decode_bundles(bundles)
    marker = F.struct(
        F.when(F.col("bad"), -1).otherwise(0).alias("pos"),
        F.when(F.col("bad"), _reason()).alias("full_url"),
        F.lit(BUNDLE_ROW).alias("resource_type"),
        F.when(F.col("bad"), F.coalesce(F.base64("raw"), "value")).alias("resource"),
        F.lit(None).cast("string").alias("linked"),
    )
    unnested = _unnested(decoded, F.array(marker).alias("marker"))
    every = [F.col("marker"), F.col("all")]
    if types is not None:
        wanted = F.filter("all", lambda r: r["resource_type"].isin(*types))
        every = [F.col("marker"), wanted, _dropped_counts(F.col("all"), types)]
    rows = unnested.select("bundle_id", F.inline(F.concat(*every)))

    kind, pos = F.col("resource_type"), F.col("pos")
    dropped = F.coalesce(F.sum(F.when(kind == DROPPED_ROW, pos)), F.lit(0))
    kept = F.count_if(kind.isNull() | ~kind.isin(BUNDLE_ROW, DROPPED_ROW))
    seen = Observation()
    rows = rows.observe(
        seen,
        F.count_if((kind == BUNDLE_ROW) & (pos >= 0)).alias("bundles_ok"),
        F.count_if((kind == BUNDLE_ROW) & (pos < 0)).alias("bundles_failed"),
        (kept + dropped).alias("entries"),
        kept.alias("entries_kept"),
        dropped.alias("entries_dropped"),
    )
    rows.write.mode("overwrite").partitionBy("resource_type").parquet(path)
    schema = "bundle_id string, pos int, full_url string, resource string, linked string, resource_type string"
    return Staged(spark.read.schema(schema).parquet(path), dict(seen.get))


def ingest_report(
    staged: Staged, records: dict[str, DataFrame], unreadable: DataFrame | None = None
) -> DataFrame:
    """Readable and failed bundles as observed, then rows per flat record set (best given as read back).

    ``unreadable`` (see `flatten.unreadable`) adds the number of resources with fields that were lost.
    """
    if unreadable is not None:
        records = records | {"resources_unreadable": unreadable}
    spark = staged.table.sparkSession
    report = spark.createDataFrame([(c, staged.metrics[c]) for c in ("bundles_ok", "bundles_failed")], "item string, n long")
    for name, df in records.items():
        report = report.unionByName(
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        )
    return report
