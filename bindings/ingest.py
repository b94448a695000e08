"""Bundle intake, flattening, bronze loads and catalog (S, N).

Queries that write do so in a fresh folder under the cluster's shared folder and return
what is read back.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.documents import FILLED, READABLE
from bindings.registry import PLAIN, Data, register
from fhirlake import schemas
from fhirlake.functions import paths
from fhirlake.operators import dedupe, flatten, inspect, profile
from fhirlake.sources import bronze, bundles, catalog, latest, parsed, shared

RECORDS = tuple(schemas.RECORDS)
LOADED_AT = dt.datetime(2024, 3, 1, 12, 0, 0)


PER_FILE = 500


def _write_files(d: Data) -> str:
    """One JSON file per range of 500 customer numbers, each one bundle of their patients.

    Customer numbers are unique, so a bundle has at most 500 entries at any scale.
    """
    folder = shared.shared_dir(d.spark, "bundles")
    patients = bundles.explode_resources(bundles.decode_bundles(d.bundles("customer"))).filter(
        "resource_type = 'Patient'"
    )
    number = F.floor(F.substr("bundle_id", F.lit(2)).cast("long") / PER_FILE)
    docs = patients.groupBy(number.cast("string").alias("id")).agg(
        F.lit("Bundle").alias("resourceType"),
        F.collect_list(F.struct(F.parse_json("resource").alias("resource"))).alias("entry"),
    )
    docs.write.option("maxRecordsPerFile", 1).json(folder)
    return folder


def _entries(files: DataFrame) -> DataFrame:
    return bundles.decode_bundles(files).select(
        F.get_json_object("value", "$.id").alias("id"), F.size("entry").cast("long").alias("entries"), "bad"
    )


register(
    "S01_read_bundles",
    lambda d: _entries(bundles.read_bundles(d.spark, _write_files(d))),
    f"SELECT cast(c_custkey // {PER_FILE} AS varchar) AS id, count(*) AS entries, false AS bad "
    f"FROM customer WHERE {FILLED} GROUP BY 1",
)
register(
    "S02_first_bundles",
    lambda d: bundles.read_bundles(d.spark, _write_files(d), limit=2).agg(
        F.countDistinct("bundle_id").alias("n"), F.count_if(F.col("bundle_id").endswith(".json")).alias("files")
    ),
    f"SELECT least(2, count(DISTINCT c_custkey // {PER_FILE})) AS n, least(2, count(DISTINCT c_custkey // {PER_FILE})) AS files "
    f"FROM customer WHERE {FILLED}",
)
register(
    "S03_decode",
    lambda d: bundles.decode_bundles(d.bundles("customer")).select(
        "bundle_id", F.size("entry").cast("long").alias("entries"), "bad"
    ),
    f"SELECT 'c' || c_custkey AS bundle_id, CASE WHEN {FILLED} THEN cast(1 + cast(c_custkey % 13 = 0 AS int) "
    f"+ cast(c_custkey % 29 = 0 AS int) AS bigint) END AS entries, NOT ({READABLE}) AS bad FROM customer",
)


def _tailed(d: Data) -> DataFrame:
    """Every third document as it is, every third twice in one file, every third with text behind it."""
    number = F.substr("bundle_id", F.lit(2)).cast("long") % 3
    twice, text = F.concat("value", F.lit("\n"), "value"), F.concat("value", F.lit(" x"))
    value = F.when(number == 1, twice).when(number == 2, text).otherwise(F.col("value"))
    return d.bundles("customer").withColumn("value", value)


register(
    "S03_whole_documents",
    lambda d: bundles.decode_bundles(_tailed(d)).select("bundle_id", "bad"),
    f"SELECT 'c' || c_custkey AS bundle_id, NOT ({READABLE}) OR c_custkey % 3 <> 0 AS bad FROM customer",
)
register(
    "S04_reasons",
    lambda d: bundles.split_bad_bundles(_tailed(d))[1].select("bundle_id", "reason"),
    "SELECT 'c' || c_custkey AS bundle_id, "
    f"CASE WHEN {READABLE} THEN 'text after the document' WHEN c_custkey % 17 = 0 THEN 'malformed document' "
    f"ELSE 'not a JSON object' END AS reason FROM customer WHERE NOT ({READABLE}) OR c_custkey % 3 <> 0",
)
_QUARANTINE = (
    "SELECT 'c' || c_custkey AS bundle_id, CASE WHEN c_custkey % 17 = 0 THEN 'malformed document' "
    "ELSE 'not a JSON object' END AS reason, CASE WHEN c_custkey % 17 = 0 THEN '{bad' || c_custkey ELSE '[1,2]' END AS value "
    f"FROM customer WHERE NOT ({READABLE})"
)
register("S04_quarantine", lambda d: bundles.split_bad_bundles(d.bundles("customer"))[1].drop("raw"), _QUARANTINE)
register("S04_staged_quarantine", lambda d: bundles.stage_bundles(d.bundles("customer")).quarantine.drop("raw"), _QUARANTINE)


def _bytes(d: Data) -> DataFrame:
    """The customers' documents as bytes; in every third the letter after `"id":"` is no UTF-8."""
    third = F.substr("bundle_id", F.lit(2)).cast("long") % 3 == 0
    place = F.expr("""instr(value, '"id":"') + 5""")
    broken = F.concat(
        F.expr("left(value, 0)").cast("binary"),
        F.substring(F.col("value"), F.lit(1), place).cast("binary"),
        F.lit(b"\xff"),
        F.expr("""substring(value, instr(value, '"id":"') + 6)""").cast("binary"),
    )
    value = F.when(third, broken).otherwise(F.col("value").cast("binary"))
    return d.bundles("customer").withColumn("value", value)


# What the documents are made of (see documents.CUSTOMER_DOC): a readable one has its id right after the type.
_THIRD = "c_custkey % 3 = 0"
_BYTES_TEXT = f"CASE WHEN c_custkey % 17 = 0 THEN '{{bad' || c_custkey WHEN c_custkey % 19 = 0 THEN '[1,2]' ELSE '{{}}' END"
register(
    "S03_strict_decode",
    lambda d: bundles.decode_bundles(_bytes(d)).select("bundle_id", "bad", F.col("raw").isNotNull().alias("has_bytes")),
    f"SELECT 'c' || c_custkey AS bundle_id, {_THIRD} OR NOT ({READABLE}) AS bad, {_THIRD} AS has_bytes FROM customer",
)


def _bad_bytes(d: Data) -> DataFrame:
    """The staged quarantine: reason, the parser's message, and whether the bytes are those that were read."""
    given = _bytes(d).select("bundle_id", F.sha2("value", 256).alias("given"))
    found = bundles.failure_messages(bundles.stage_bundles(_bytes(d)).quarantine)
    kept = F.sha2(F.coalesce("raw", F.col("value").cast("binary")), 256)
    same = found.withColumn("kept", kept).join(given, "bundle_id")
    return same.select("bundle_id", "reason", "message", (F.col("kept") == F.col("given")).alias("whole"))


# The byte replaces nothing, it stands before the sixth character after the place of `"id":"`, or first where there is none.
_AT = "CASE WHEN {filled} THEN 31 ELSE 5 END".format(filled=FILLED)
register(
    "S04_bytes",
    _bad_bytes,
    f"SELECT 'c' || c_custkey AS bundle_id, CASE WHEN {_THIRD} THEN 'not UTF-8' WHEN c_custkey % 17 = 0 THEN 'malformed document' "
    "ELSE 'not a JSON object' END AS reason, "
    f"CASE WHEN {_THIRD} THEN 'UnicodeDecodeError: ''utf-8'' codec can''t decode byte 0xff in position ' || least(place, size) || ': invalid start byte' "
    "WHEN c_custkey % 17 = 0 THEN 'JSONDecodeError: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' "
    "ELSE 'TypeError: a bundle must be an object, not list' END AS message, true AS whole "
    f"FROM (SELECT *, {_AT} AS place, CASE WHEN {FILLED} THEN 31 ELSE length({_BYTES_TEXT}) END AS size FROM customer) "
    f"WHERE {_THIRD} OR NOT ({READABLE})",
)


# --- files: two folders with equal names, bad files, files without a byte, names to skip ---

PER_NAMED = 25


def _write_named(files: DataFrame, folder: str) -> DataFrame:
    """(name, content) as files of these names; a repeated task writes the same bytes again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content"))):
                place = f"{path}/{name}"
                there.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with there.open_output_stream(place, compression=None) as out:
                    out.write(content)
            yield batch.select(["name"])

    return files.select("name", "content").mapInArrow(write, "name string")


def _named_files(d: Data) -> list[str]:
    """Folders a and b with a file of the same name per 25 customers; in a some are bad, in b all are good.

    Beside them stand files whose names are to be skipped.
    """
    folder = shared.shared_dir(d.spark, "files")
    folder = folder if ":" in folder else f"file://{folder}"
    number = F.floor(F.col("c_custkey") / PER_NAMED).cast("string")
    groups = d.table("customer").groupBy(number.alias("n")).agg(F.count("*").alias("entries"))
    bundle = F.concat(F.lit('{"entry":['), F.array_join(F.array_repeat(F.lit("{}"), F.col("entries").cast("int")), ","), F.lit("]}"))
    kind = F.col("n").cast("long") % 4
    bad = F.when(kind == 1, F.lit(b"")).when(kind == 2, F.lit(b'{"id":"\xff"}')).when(kind == 3, F.lit(b"{bad"))
    groups = groups.withColumn("good", bundle.cast("binary"))
    names = {"a/b": ".json", "b/b": ".json", "a/hospitalInformation": ".json", "b/practitionerInformation": ".json", "b/n": ".txt"}
    files = F.array(
        *[
            F.struct(
                F.concat(F.lit(start), "n", F.lit(end)).alias("name"),
                F.coalesce(bad if start == "a/b" else F.col("good"), "good").alias("content"),
            )
            for start, end in names.items()
        ]
    )
    _write_named(groups.select(F.inline(files)), folder).count()
    return [f"{folder}/a", f"{folder}/b"]


def _with_names(found: DataFrame) -> DataFrame:
    part = F.split("bundle_id", "/")
    return found.withColumns({"folder": F.element_at(part, -2), "name": F.element_at(part, -1)})


_NAMED = (
    "SELECT folder, 'b' || n || '.json' AS name, entries, folder = 'a' AND n % 4 <> 0 AS bad, "
    "CASE WHEN folder = 'b' OR n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'empty file' WHEN n % 4 = 2 THEN 'not UTF-8' ELSE 'malformed document' END AS reason "
    f"FROM (SELECT c_custkey // {PER_NAMED} AS n, count(*) AS entries FROM customer GROUP BY 1), (VALUES ('a'), ('b')) f(folder)"
)
register(
    "S01_named_files",
    lambda d: _with_names(bundles.decode_bundles(bundles.read_bundles(d.spark, _named_files(d)))).select(
        "folder", "name", "bad", F.when(~F.col("bad"), F.size("entry").cast("long")).alias("entries")
    ),
    f"SELECT folder, name, bad, CASE WHEN NOT bad THEN entries END AS entries FROM ({_NAMED})",
)
FIRST_FILES = 7
register(
    "S02_first_named_files",
    lambda d: _with_names(bundles.decode_bundles(bundles.read_bundles(d.spark, _named_files(d), limit=FIRST_FILES))).select(
        "folder", "name", "bad"
    ),
    f"SELECT folder, name, bad FROM ({_NAMED}) ORDER BY name, folder LIMIT {FIRST_FILES}",
)
register(
    "S05_failed_files",
    lambda d: _with_names(bundles.stage_bundles(bundles.read_bundles(d.spark, _named_files(d))).quarantine).select("folder", "name", "reason"),
    f"SELECT folder, name, reason FROM ({_NAMED}) WHERE bad",
)
register(
    "S06_file_index",
    lambda d: _with_names(bundles.file_index(d.spark, _named_files(d)).drop("name")).select("folder", "name", "length"),
    "SELECT folder, name, CASE reason WHEN 'empty file' THEN 0 WHEN 'not UTF-8' THEN 10 WHEN 'malformed document' THEN 4 "
    f"ELSE 12 + entries * 2 + entries - 1 END AS length FROM ({_NAMED})",
)


def _observed(d: Data, types: tuple[str, ...]) -> DataFrame:
    """What the staging write observed, and the entries of every type, kept or not."""
    staged = bundles.stage_bundles(d.bundles(), types=types)
    seen = d.spark.createDataFrame(list(staged.metrics.items()), "item string, n long")
    return seen.unionByName(bundles.resource_type_counts(staged).withColumnRenamed("resource_type", "item"))


def _report(d: Data) -> DataFrame:
    staged = bundles.stage_bundles(d.bundles())
    return bundles.ingest_report(staged, flatten.flatten_all(staged.resources))


register(
    "S05_ingest_report",
    _report,
    f"SELECT 'bundles_ok' AS item, (SELECT count(*) FROM customer WHERE {READABLE}) + (SELECT count(*) FROM orders) "
    "+ (SELECT count(*) FROM events) AS n "
    f"UNION ALL SELECT 'bundles_failed', (SELECT count(*) FROM customer WHERE NOT ({READABLE})) "
    + "".join(f" UNION ALL SELECT '{r}', (SELECT count(*) FROM doc_{r})" for r in RECORDS),
)
register(
    "S06_require_input",
    lambda d: profile.row_count(bundles.require_bundles(d.bundles("orders"))),
    "SELECT count(*) AS n FROM orders",
)


def _flat(d: Data) -> dict[str, DataFrame]:
    return flatten.flatten_all(_staged(d))


def _parsed(d: Data) -> str:
    folder = shared.shared_dir(d.spark, "parsed")
    parsed.write_parsed(_flat(d), folder)
    return folder


register(
    "S07_write_parsed",
    lambda d: profile.layer_row_counts({r: d.spark.read.parquet(parsed.record_path(f, r)) for f in [_parsed(d)] for r in RECORDS}),
    " UNION ALL ".join(f"SELECT '{r}' AS table_name, count(*) AS n FROM doc_{r}" for r in RECORDS),
)


def _round_trip(d: Data, record: str) -> DataFrame:
    folder = shared.shared_dir(d.spark, "parsed")
    resources = bundles.explode_resources(bundles.decode_bundles(d.bundles("orders")))
    parsed.write_parsed({record: flatten.EXTRACTORS["Encounter"][1](resources)}, folder)
    parsed.check_inputs(d.spark, folder, [record])
    return parsed.read_parsed(d.spark, folder, record)


register("S08_read_parsed", lambda d: _round_trip(d, "encounters"), "SELECT * FROM doc_encounters")
register(
    "S09_check_inputs",
    lambda d: profile.row_count(_round_trip(d, "encounters")),
    "SELECT count(*) AS n FROM doc_encounters",
)

CHECK_DB = "fhirlake_check"


def _load(d: Data, record: str, modes: list[str]) -> DataFrame:
    """Load the record set once per mode, as batches batch-0, batch-1, ..."""
    if not d.spark.catalog.databaseExists(CHECK_DB):
        bronze.create_layers(d.spark, (CHECK_DB,), shared.shared_dir(d.spark, "tables"))
    bronze.create_bronze(d.spark, CHECK_DB)
    columns = schemas.RECORDS[record].names
    rows = d.bronze(record).select(*columns)
    for i, mode in enumerate(modes):
        bronze.load_bronze(rows, record, mode, batch_id=f"batch-{i}", ts=LOADED_AT, database=CHECK_DB)
    return bronze.source(d.spark, record, CHECK_DB)


_LOADED = (
    "SELECT * EXCLUDE (load_timestamp, load_batch_id), timestamp '2024-03-01 12:00:00' AS load_timestamp, "
    "'{batch}' AS load_batch_id FROM bronze_{record}"
)
register(
    "S10_load_replace",
    lambda d: _load(d, "encounters", ["replace", "replace"]),
    _LOADED.format(batch="batch-1", record="encounters"),
)
register(
    "S11_load_append",
    lambda d: _load(d, "patients", ["replace", "append"]),
    " UNION ALL ".join(_LOADED.format(batch=f"batch-{i}", record="patients") for i in (0, 1)),
)
register(
    "S12_stamp_audit",
    lambda d: bronze.stamp_audit(d.bronze("patients").drop("load_timestamp", "load_batch_id"), "b7", LOADED_AT),
    _LOADED.format(batch="b7", record="patients"),
)


def _typed(d: Data) -> DataFrame:
    resources = bundles.explode_resources(bundles.decode_bundles(d.bundles("orders")))
    return parsed.cast_to(flatten.flatten_encounters(resources), schemas.RECORDS["encounters"])


# The oracle takes the wall clock, i.e. the first 19 characters of the ISO text.
register(
    "S13_cast_to",
    _typed,
    "SELECT * REPLACE (cast(substr(start_time, 1, 19) AS timestamp) AS start_time, "
    "cast(substr(end_time, 1, 19) AS timestamp) AS end_time) FROM doc_encounters",
)
register(
    "S14_reconcile",
    lambda d: bronze.batch_counts(
        d.bronze("encounters"), _load(d, "encounters", ["replace", "append"]), "batch-1"
    ),
    "SELECT count(*) AS source_rows, count(*) AS loaded_rows, 'OK' AS status FROM bronze_encounters",
)


def _load_report(d: Data) -> DataFrame:
    """One batch of all record sets, of which some patients were lost on the way."""
    pairs = {}
    for record in RECORDS:
        rows = d.bronze(record).drop("load_timestamp", "load_batch_id")
        loaded = rows.filter("patient_id NOT LIKE '%1'") if record == "patients" else rows
        pairs[record] = (rows, bronze.stamp_audit(loaded, "b1", LOADED_AT))
    return bronze.load_report(pairs, "b1")


register(
    "S14_load_report",
    _load_report,
    "SELECT 'patients' AS table_name, count(*) AS source_rows, count(*) FILTER (patient_id NOT LIKE '%1') AS loaded_rows, "
    "'MISMATCH' AS status FROM bronze_patients "
    + "".join(
        f" UNION ALL SELECT '{r}', count(*), count(*), 'OK' FROM bronze_{r}" for r in RECORDS if r != "patients"
    ),
)


# --- content of batches, typing with rejects, latest rows kept up to date ---


def _swapped(rows: DataFrame, key: str, lost: str, doubled: str) -> DataFrame:
    """One key's rows lost, another's doubled: as many rows as before, if each has as many."""
    return rows.filter(F.col(key) != lost).unionByName(rows.filter(F.col(key) == doubled))


def _content_report(d: Data) -> DataFrame:
    """Two batches of single patients: one complete, one with a row lost and another doubled; and their report by counts."""
    rows = dedupe.latest_by(d.bronze("patients"), "patient_id").drop(*schemas.AUDIT.names)
    whole = bronze.stamp_audit(rows, "whole", LOADED_AT)
    swapped = bronze.stamp_audit(_swapped(rows, "patient_id", "p1", "p2"), "swapped", LOADED_AT)
    parts = [
        check(rows, table, batch).select(F.lit(batch).alias("batch"), F.lit(kind).alias("kind"), "*")
        for kind, check in (("content", bronze.batch_content), ("counts", bronze.batch_counts))
        for batch, table in (("whole", whole), ("swapped", swapped))
    ]
    return reduce(DataFrame.unionByName, parts)


register(
    "S14_content",
    _content_report,
    "SELECT batch, kind, n AS source_rows, n AS loaded_rows, CASE WHEN kind = 'content' AND batch = 'swapped' THEN 'MISMATCH' ELSE 'OK' END AS status "
    "FROM (SELECT count(DISTINCT patient_id) AS n FROM bronze_patients), (VALUES ('whole'), ('swapped')) b(batch), (VALUES ('content'), ('counts')) k(kind)",
)


def _dated(d: Data) -> DataFrame:
    """Parsed encounters, every seventh with a start that is no date."""
    resources = bundles.explode_resources(bundles.decode_bundles(d.bundles("orders")))
    rows = flatten.flatten_encounters(resources)
    seventh = F.substr("encounter_id", F.lit(2)).cast("long") % 7 == 0
    return rows.withColumn("start_time", F.when(seventh, F.concat(F.lit("on "), "start_time")).otherwise(F.col("start_time")))


_SEVENTH = "cast(substr(encounter_id, 2) AS bigint) % 7 = 0"
_WALL = "cast(substr({0}, 1, 19) AS timestamp)"
register(
    "S13_type_once",
    lambda d: parsed.type_once(_dated(d), schemas.RECORDS["encounters"]).rows,
    f"SELECT * REPLACE (CASE WHEN NOT ({_SEVENTH}) THEN {_WALL.format('start_time')} END AS start_time, "
    f"{_WALL.format('end_time')} AS end_time) FROM doc_encounters",
)
register(
    "S13_rejected",
    lambda d: parsed.type_once(_dated(d), schemas.RECORDS["encounters"]).rejected.select(
        "encounter_id", "start_time", F.array_join("rejected_columns", ",").alias("lost")
    ),
    f"SELECT encounter_id, 'on ' || start_time AS start_time, 'start_time' AS lost FROM doc_encounters WHERE {_SEVENTH}",
)


def _merged(d: Data) -> DataFrame:
    """Line items arriving in three batches by ship date's month, one of them twice."""
    if not d.spark.catalog.databaseExists(CHECK_DB):
        bronze.create_layers(d.spark, (CHECK_DB,), shared.shared_dir(d.spark, "tables"))
    rows = d.table("lineitem")
    table = f"{CHECK_DB}.latest_{uuid.uuid4().hex}"
    latest.create_latest(d.spark, table, rows, ["l_orderkey", "l_linenumber"], 16)
    tiebreak = ["l_partkey", "l_suppkey", "l_extendedprice"]
    for third in (2, 0, 1, 0):
        latest.merge_latest(table, rows.filter(F.month("l_shipdate") % 3 == third), "l_shipdate", tiebreak)
    found = shared.through_table(latest.latest(d.spark, table), "latest")
    d.spark.sql(f"DROP TABLE {table}")
    return found


register(
    "W01_merge_latest",
    _merged,
    "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1",
)


def _created_twice(d: Data) -> DataFrame:
    loaded = _load(d, "encounters", ["replace"])
    bronze.create_bronze(d.spark, CHECK_DB)
    return loaded.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len(loaded.columns)).cast("long"))


register("S16_create_bronze", _created_twice, "SELECT count(*) AS n, cast(14 AS bigint) AS columns FROM bronze_encounters")
register(
    "S17_column_report",
    lambda d: catalog.column_report(_load(d, "conditions", ["replace"])).filter("column_type <> 'string'").drop("position"),
    "SELECT * FROM (VALUES ('onset_date', 'timestamp_ntz'), ('abatement_date', 'timestamp_ntz'), "
    "('recorded_date', 'timestamp_ntz'), ('load_timestamp', 'timestamp_ntz')) AS t(column_name, column_type) "
    "WHERE (SELECT count(*) FROM customer) > 0",
)
_PROFILED = ("condition_id", "encounter_id", "code", "display", "abatement_date", "load_batch_id")
register(
    "S17_column_profile",
    lambda d: catalog.column_profile(_load(d, "conditions", ["replace"]).select(*_PROFILED)),
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{'timestamp_ntz' if c == 'abatement_date' else 'string'}' AS column_type, "
        f"count(*) AS rows, {'count(*)' if c == 'load_batch_id' else f'count({c})'} AS non_null FROM bronze_conditions"
        for i, c in enumerate(_PROFILED)
    ),
)


def _from_ddl(d: Data) -> DataFrame:
    """The bronze encounters in a table made from the DDL of theirs."""
    loaded = _load(d, "encounters", ["replace"])
    copy = f"{CHECK_DB}.copy_{uuid.uuid4().hex}"
    catalog.create_like(d.spark, bronze.bronze_name("encounters", CHECK_DB), copy)
    loaded.select(*d.spark.table(copy).columns).write.insertInto(copy)
    found = shared.through_table(d.spark.table(copy), "copy")
    d.spark.sql(f"DROP TABLE {copy}")
    return found


register("S17_table_from_ddl", _from_ddl, _LOADED.format(batch="batch-0", record="encounters"))
register(
    "S15_bronze_state",
    lambda d: bronze.bronze_state({f"bronze_{r}": d.bronze(r) for r in RECORDS}),
    " UNION ALL ".join(
        f"SELECT 'bronze_{r}' AS table_name, count(*) AS rows, count(DISTINCT load_batch_id) AS batches FROM bronze_{r}"
        for r in RECORDS
    ),
)


def _catalog(d: Data) -> DataFrame:
    _load(d, "observations", ["replace"])
    report = catalog.catalog_report(d.spark, [CHECK_DB])
    return report.filter("table_name = 'bronze_observations'")


register(
    "S17_catalog_report",
    _catalog,
    f"SELECT '{CHECK_DB}' AS table_schema, 'bronze_observations' AS table_name, cast(17 AS bigint) AS columns, "
    "count(*) AS rows FROM bronze_observations",
)


def _materialized(d: Data) -> DataFrame:
    if not d.spark.catalog.databaseExists(CHECK_DB):
        bronze.create_layers(d.spark, (CHECK_DB,), shared.shared_dir(d.spark, "tables"))
    return catalog.materialize(d.silver("observations"), CHECK_DB, "silver_observations", "patient_id", 8)


register("S18_materialize", _materialized, "SELECT * FROM silver_observations")
register(
    "S19_source",
    lambda d: _load(d, "conditions", ["replace"]).select("condition_id", "patient_id", "code", "load_batch_id"),
    "SELECT condition_id, patient_id, code, 'batch-0' AS load_batch_id FROM bronze_conditions",
)
register(
    "S20_sample_rows",
    lambda d: profile.sample_rows(d.silver("patients"), 3, "patient_id"),
    "SELECT * FROM silver_patients ORDER BY patient_id LIMIT 3",
)

# --- N: nested data ---


def _resources(d: Data, *sources: str) -> DataFrame:
    return bundles.explode_resources(bundles.decode_bundles(d.bundles(*sources)))


def _staged(d: Data, *sources: str) -> DataFrame:
    return bundles.stage_bundles(d.bundles(*sources)).resources


register(
    "N01_explode_resources",
    lambda d: _resources(d, "customer").select("bundle_id", F.col("pos").cast("long").alias("pos"), "resource_type"),
    "SELECT 'c' || c_custkey AS bundle_id, cast(0 AS bigint) AS pos, 'Patient' AS resource_type "
    f"FROM customer WHERE {FILLED} UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END, NULL "
    f"FROM customer WHERE {FILLED} AND c_custkey % 29 = 0",
)
register(
    "N02_flatten_all",
    lambda d: profile.layer_row_counts(_flat(d)),
    " UNION ALL ".join(f"SELECT '{r}' AS table_name, count(*) AS n FROM doc_{r}" for r in RECORDS),
)
register(
    "N03_get_path",
    lambda d: _resources(d, "customer").filter("resource_type = 'Patient'").select(
        "bundle_id", F.from_json("resource", schemas.RESOURCES["Patient"]).alias("r")
    ).select(
        "bundle_id",
        paths.get_path(F.col("r"), "name", 0, "family").alias("family"),
        paths.get_path(F.col("r"), "name", 1, "family").alias("second_family"),
        paths.get_path(F.col("r"), "address", 7, "city").alias("eighth_city"),
    ),
    "SELECT 'c' || c_custkey AS bundle_id, CASE WHEN c_custkey % 31 <> 0 THEN 'F' || c_custkey % 100 END AS family, "
    "CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 4 <> 0 THEN 'Z' END AS second_family, cast(NULL AS varchar) AS eighth_city "
    f"FROM customer WHERE {FILLED}",
)
_REFS = [
    ("'urn:uuid:p' || k", "'p' || k"),
    ("'Patient/p' || k", "'p' || k"),
    ("'Organization?identifier=https://x/ids|p' || k", "'p' || k"),
    ("'Org?identifier=a=p' || k", "'p' || k"),
    ("'p' || k", "'p' || k"),
    ("'http://h/Patient/x' || k", "'/h/Patient/x' || k"),
    ("''", "NULL"),
    ("NULL", "NULL"),
]


def _ref_case(column: int) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN {pair[column]}" for i, pair in enumerate(_REFS)) + " END"


register(
    "N04_normalize_ref",
    lambda d: d.table("orders").select(F.col("o_orderkey").alias("k")).select(
        "k", paths.normalize_ref(F.expr(_ref_case(0))).alias("id")
    ),
    f"SELECT k, {_ref_case(1)} AS id FROM (SELECT o_orderkey AS k FROM orders)",
)
register(
    "N05_us_core_display",
    lambda d: flatten.flatten_patients(_resources(d, "customer")).select("patient_id", "race", "ethnicity"),
    "SELECT patient_id, race, ethnicity FROM doc_patients",
)
register("N06_flatten_patients", lambda d: flatten.flatten_patients(_resources(d, "customer")), "SELECT * FROM doc_patients")
register("N07_flatten_encounters", lambda d: flatten.flatten_encounters(_resources(d, "orders")), "SELECT * FROM doc_encounters")
register("N08_flatten_conditions", lambda d: flatten.flatten_conditions(_resources(d, "orders")), "SELECT * FROM doc_conditions")
register(
    "N09_medication_lookup",
    lambda d: flatten.medication_lookup(_resources(d, "orders")).select(
        "bundle_id", "medication_id", F.col("coding.system").alias("code_system"), F.col("coding.code").alias("medication_code")
    ),
    "SELECT * FROM doc_medication_lookup",
)
register(
    "N10_flatten_medication_requests",
    lambda d: flatten.flatten_medication_requests(_staged(d, "orders")),
    "SELECT * FROM doc_medication_requests",
)
# J07 is the bundle-local resolution inside N10: the rows it fills, and from where.
register(
    "J07_resolved_references",
    lambda d: flatten.flatten_medication_requests(_staged(d, "orders"))
    .filter("code_system IN ('sys-a', 'sys-b', 'sys-c')")
    .select("medication_request_id", "medication_code"),
    "SELECT medication_request_id, medication_code FROM doc_medication_requests WHERE code_system IN ('sys-b', 'sys-c')",
)
register(
    "N11_flatten_observations",
    lambda d: flatten.flatten_observations(_resources(d, "events")),
    "SELECT * FROM doc_observations",
)
for name, where in {
    "N12_components": "parent_observation_id IS NOT NULL",
    "N13_quantities": "parent_observation_id IS NULL AND value_numeric IS NOT NULL",
    "N14_concepts": "parent_observation_id IS NULL AND value_code IS NOT NULL",
    "N15_strings": "parent_observation_id IS NULL AND value_text IS NOT NULL AND value_code IS NULL",
}.items():
    register(
        name,
        lambda d, w=where: flatten.flatten_observations(_resources(d, "events")).filter(w),
        f"SELECT * FROM doc_observations WHERE {where}",
    )


def _entries_of(d: Data, *sources: str) -> DataFrame:
    return bundles.explode_entries(bundles.decode_bundles(d.bundles(*sources)))


_TYPE_COUNTS = (
    f"SELECT 'Patient' AS resource_type, count(*) AS n FROM customer WHERE {FILLED} "
    "UNION ALL SELECT 'Unknown', (SELECT count(*) FROM customer WHERE {f} AND c_custkey % 13 = 0) "
    "+ (SELECT count(*) FROM customer WHERE {f} AND c_custkey % 29 = 0) ".replace("{f}", FILLED)
    + "UNION ALL SELECT 'Encounter', count(*) FROM orders UNION ALL SELECT 'Condition', count(*) FROM orders "
    "UNION ALL SELECT 'MedicationRequest', count(*) FROM orders UNION ALL SELECT 'Medication', "
    "count(*) + count(*) FILTER (WHERE o_orderkey % 6 = 1) FROM orders WHERE o_orderkey % 6 IN (0, 1, 3, 5) "
    "UNION ALL SELECT 'Observation', count(*) FROM events"
)
_OK = f"(SELECT count(*) FROM customer WHERE {READABLE}) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events)"


def _observed_sql(types: tuple[str, ...]) -> str:
    kept = f"resource_type IN ({', '.join(f"'{t}'" for t in types)})"
    return (
        f"WITH by_type AS ({_TYPE_COUNTS}) SELECT resource_type AS item, n FROM by_type "
        f"UNION ALL SELECT 'bundles_ok', {_OK} UNION ALL SELECT 'bundles_failed', count(*) FROM customer WHERE NOT ({READABLE}) "
        "UNION ALL SELECT 'entries', cast(sum(n) AS bigint) FROM by_type "
        f"UNION ALL SELECT 'entries_kept', cast(coalesce(sum(n), 0) AS bigint) FROM by_type WHERE {kept} "
        f"UNION ALL SELECT 'entries_dropped', cast(coalesce(sum(n), 0) AS bigint) FROM by_type WHERE NOT {kept}"
    )


register("S05_observed", lambda d: _observed(d, flatten.SOURCE_TYPES), _observed_sql(flatten.SOURCE_TYPES))
register("S05_observed_few_types", lambda d: _observed(d, ("Patient", "Condition")), _observed_sql(("Patient", "Condition")))
register(
    "N16_dropped_per_bundle",
    lambda d: bundles.resource_type_counts(bundles.stage_bundles(d.bundles("customer"), types=("Encounter",)), per_bundle=True),
    f"SELECT 'c' || c_custkey AS bundle_id, 'Patient' AS resource_type, 1 AS n FROM customer WHERE {FILLED} "
    "UNION ALL SELECT 'c' || c_custkey, 'Unknown', cast(c_custkey % 13 = 0 AS int) + cast(c_custkey % 29 = 0 AS int) "
    f"FROM customer WHERE {FILLED} AND (c_custkey % 13 = 0 OR c_custkey % 29 = 0)",
)
register("N16_resource_type_counts", lambda d: bundles.resource_type_counts(bundles.stage_bundles(d.bundles()).entries), _TYPE_COUNTS)
register(
    "N16_resource_type_totals",
    lambda d: bundles.resource_type_totals(_entries_of(d)),
    f"SELECT cast(sum(n) AS bigint) AS entries, count(*) AS resource_types FROM ({_TYPE_COUNTS})",
)
register(
    "N16_counts_per_bundle",
    lambda d: bundles.resource_type_counts(_entries_of(d, "orders"), per_bundle=True),
    "SELECT 'o' || o_orderkey AS bundle_id, t.resource_type, cast(1 + cast(t.resource_type = 'Medication' AND o_orderkey % 6 = 1 AS int) AS bigint) AS n "
    "FROM orders, (VALUES ('Encounter'), ('Condition'), ('MedicationRequest'), ('Medication')) t(resource_type) "
    "WHERE t.resource_type <> 'Medication' OR o_orderkey % 6 IN (0, 1, 3, 5)",
)
register(
    "N17_observation_shapes",
    lambda d: inspect.observation_shapes(_resources(d, "events")),
    "SELECT CASE event_id % 10 WHEN 0 THEN 'valueQuantity' WHEN 3 THEN 'valueQuantity' WHEN 4 THEN 'valueQuantity' "
    "WHEN 5 THEN 'valueQuantity' WHEN 6 THEN 'valueBoolean' WHEN 7 THEN 'valueCodeableConcept' WHEN 8 THEN 'valueString' "
    "ELSE 'component' END AS shape, count(*) AS n FROM events GROUP BY 1",
)
_UNVALUED = "event_id % 10 = 6"
register(
    "N18_unvalued_codes",
    lambda d: inspect.unvalued_codes(_resources(d, "events")),
    f"SELECT '4548-4' AS loinc_code, 'HbA1c' AS loinc_display, count(*) AS n FROM events WHERE {_UNVALUED}",
)
register(
    "N18_unvalued_fields",
    lambda d: inspect.unvalued_fields(_resources(d, "events")),
    "SELECT field, count(*) AS n FROM events, (VALUES ('resourceType'), ('id'), ('status'), ('subject'), ('encounter'), "
    "('effectiveDateTime'), ('issued'), ('category'), ('code'), ('valueBoolean')) f(field) "
    f"WHERE {_UNVALUED} AND (field <> 'category' OR event_id % 3 <> 0) GROUP BY field",
)
_EMPTY = "value_numeric IS NULL AND value_text IS NULL AND value_code IS NULL"
register(
    "N19_empty_rows",
    lambda d: inspect.empty_observation_counts(flatten.flatten_observations(_resources(d, "events"))),
    "SELECT count(*) AS empty_rows, count(parent_observation_id) AS from_components, "
    f"count(*) - count(parent_observation_id) AS not_from_components FROM doc_observations WHERE {_EMPTY}",
)
register(
    "N19_empty_codes",
    lambda d: profile.top_k(
        inspect.empty_observation_rows(flatten.flatten_observations(_resources(d, "events"))),
        ["loinc_code", "loinc_display"], 15,
    ),
    f"SELECT loinc_code, loinc_display, count(*) AS n FROM doc_observations WHERE {_EMPTY} GROUP BY 1, 2",
)
register(
    "N20_find_resource",
    lambda d: inspect.find_resource(_resources(d, "orders"), "MedicationRequest", "mr42").select(
        "bundle_id", "resource_type", F.get_json_object("resource", "$.status").alias("status")
    ),
    "SELECT 'o' || o_orderkey AS bundle_id, 'MedicationRequest' AS resource_type, 'active' AS status "
    "FROM orders WHERE o_orderkey = 42",
)
register(
    "N20_medication_forms",
    lambda d: inspect.medication_forms(_resources(d, "orders")),
    "SELECT 'o' || o_orderkey AS bundle_id, 'mr' || o_orderkey AS medication_request_id, o_orderkey % 6 IN (0, 3, 4) AS has_inline, "
    "o_orderkey % 6 <> 5 AS has_reference, false AS has_medication, cast(0 AS bigint) AS contained_resources FROM orders",
)
register(
    "N20_component_counts",
    lambda d: inspect.component_counts(_resources(d, "events")),
    "SELECT 'v' || event_id AS bundle_id, 'o' || event_id AS observation_id, 'A1c' AS code_text, "
    "cast(CASE event_id % 10 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END AS bigint) AS components FROM events",
)


# The same diagnostics on resources that were parsed once.
for name, table, diagnose in (
    ("N17_observation_shapes", "events", inspect.observation_shapes),
    ("N18_unvalued_codes", "events", inspect.unvalued_codes),
    ("N18_unvalued_fields", "events", inspect.unvalued_fields),
    ("N20_medication_forms", "orders", inspect.medication_forms),
    ("N20_component_counts", "events", inspect.component_counts),
):
    register(
        f"{name}_variant",
        lambda d, t=table, f=diagnose: f(inspect.as_variants(_resources(d, t))),
        PLAIN[name],
    )


def _unreadable(d: Data) -> DataFrame:
    """Patients of every third bundle with an object where a list of names should be."""
    resources = bundles.explode_resources(bundles.decode_bundles(d.bundles("customer")))
    wrong = F.replace(F.col("resource"), F.lit('"gender":"male"'), F.lit('"name":{"family":"x"}'))
    third = F.substr("bundle_id", F.lit(2)).cast("long") % 3 == 0
    patients = resources.filter("resource_type = 'Patient'")
    patients = patients.withColumn("resource", F.when(third, wrong).otherwise(F.col("resource")))
    return flatten.unreadable(patients).select("bundle_id", "resource_type", "reason")


register(
    "N02_unreadable",
    _unreadable,
    "SELECT 'c' || c_custkey AS bundle_id, 'Patient' AS resource_type, 'field of another type' AS reason "
    f"FROM customer WHERE {FILLED} AND c_custkey % 3 = 0",
)


def _quoted(d: Data) -> DataFrame:
    resources = _resources(d, "events")
    quoted = F.regexp_replace("resource", r'"value":(-?[0-9.]+)', '"value":"$1"')
    return flatten.flatten_observations(resources.withColumn("resource", quoted))


register("N13_quoted_numbers", _quoted, "SELECT * FROM doc_observations")
