import datetime as dt
import json
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.operators import quality
from fhirlake.operators.flatten import flatten_all
from fhirlake.plans import contract, silver
from fhirlake.sources import bronze, bundles, catalog, parsed, shared
from fhirlake.streaming.intake import start_intake

AT = dt.datetime(2024, 3, 1, 12)


@pytest.fixture
def database(spark):
    name = f"b{uuid.uuid4().hex[:8]}"
    bronze.create_bronze(spark, name)
    bronze.create_bronze(spark, name)  # again: existing tables are left alone
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def encounters(spark, *starts):
    schema = schemas.parsed_schema("encounters")
    rows = [tuple({"encounter_id": f"e{i}", "start_time": s}.get(n) for n in schema.names) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, schema)


def batches(spark, database):
    rows = bronze.source(spark, "encounters", database).groupBy("load_batch_id").count().collect()
    return {r.load_batch_id: r["count"] for r in rows}


def test_load_modes(spark, database):
    df = encounters(spark, "2020-01-01T10:00:00-05:00", None)
    bronze.load_bronze(df, "encounters", batch_id="a", ts=AT, database=database)
    bronze.load_bronze(df, "encounters", "append", batch_id="b", ts=AT, database=database)
    bronze.load_bronze(df, "encounters", "append", batch_id="b", ts=AT, database=database)
    assert batches(spark, database) == {"a": 2, "b": 4}
    bronze.load_bronze(df, "encounters", "rerun", batch_id="b", ts=AT, database=database)
    assert batches(spark, database) == {"a": 2, "b": 2}
    state = bronze.bronze_state({"e": bronze.source(spark, "encounters", database)}).first()
    assert (state.rows, state.batches) == (4, 2)
    bronze.load_bronze(df, "encounters", "replace", batch_id="c", ts=AT, database=database)
    assert batches(spark, database) == {"c": 2}
    row = bronze.source(spark, "encounters", database).filter("encounter_id = 'e0'").first()
    assert (row.start_time, row.load_timestamp, row.load_batch_id) == (dt.datetime(2020, 1, 1, 10), AT, "c")


def test_bad_arguments(spark, database):
    df = encounters(spark, None)
    with pytest.raises(ValueError):
        bronze.load_bronze(df, "encounters", "upsert", database=database)
    with pytest.raises(ValueError):
        bronze.load_bronze(df, "encounters", batch_id="a'b", database=database)
    with pytest.raises(KeyError):
        bronze.source(spark, "gold", database)


def test_a_load_that_does_not_match_keeps_the_old_batch(spark, database, monkeypatch):
    bronze.load_bronze(encounters(spark, None, None), "encounters", "replace", "one", AT, database=database)
    kept = bronze._insert
    monkeypatch.setattr(bronze, "_insert", lambda rows, *args, **kw: kept(rows.limit(1), *args, **kw))
    with pytest.raises(bronze.LoadMismatch):
        bronze.load_bronze(encounters(spark, None, None), "encounters", "replace", "two", AT, database=database)
    assert batches(spark, database)["one"] == 2


def test_columns_go_by_name(spark, database):
    table = bronze.bronze_name("encounters", database)
    fields = schemas.bronze_schema("encounters").fields
    spark.sql(f"DROP TABLE {table}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reversed(fields))
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (load_batch_id)")
    bronze.load_bronze(encounters(spark, None), "encounters", "replace", "one", AT, database=database)
    assert bronze.source(spark, "encounters", database).first()["encounter_id"] == "e0"


def test_times_of_an_hour_that_comes_twice(spark):
    df = encounters(spark, "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        typed = parsed.cast_to(df, schemas.RECORDS["encounters"], tz="UTC").select("start_time").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(r[0] for r in typed) == [dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30)]


def test_a_rebuild_that_fails_keeps_the_old_table(spark, database):
    catalog.materialize(spark.range(3).toDF("n"), database, "model")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        catalog.materialize(broken, database, "model")
    assert spark.table(f"{database}.model").count() == 3
    again = catalog.materialize(spark.table(f"{database}.model").filter("n > 0"), database, "model")
    assert again.count() == 2
    assert [t.name for t in spark.catalog.listTables(database) if t.name.startswith("model")] == ["model"]


def test_a_reader_between_two_versions_sees_a_whole_table(spark, database, monkeypatch):
    catalog.materialize(spark.range(3).toDF("n"), database, "shown", "n", 2)
    seen, running = [], spark.table(f"{database}.shown")
    replace = catalog.publish

    def watched(spark, layer, name, version):
        seen.append(spark.table(f"{layer}.{name}").count())
        replace(spark, layer, name, version)
        seen.append(spark.table(f"{layer}.{name}").count())

    monkeypatch.setattr(catalog, "publish", watched)
    for rows in (5, 7, 9):
        catalog.materialize(spark.range(rows).toDF("n"), database, "shown", "n", 2)
    assert seen == [3, 5, 5, 7, 7, 9]
    kept = catalog.versions(spark, database, "shown")
    assert kept == ["shown__000000003", "shown__000000004"]
    assert [spark.table(f"{catalog.versions_of(database)}.{v}").count() for v in kept] == [7, 9]
    replace(spark, database, "shown", kept[0])
    assert spark.table(f"{database}.shown").count() == 7
    del running


def test_publication_is_one_catalog_call(spark, database, monkeypatch):
    catalog.materialize(spark.range(3).toDF("n"), database, "once")
    calls, run = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (calls.append(text), run(self, text, *a, **k))[1])
    catalog.publish(spark, database, "once", catalog.versions(spark, database, "once")[-1])
    assert [c.split()[:4] for c in calls] == [["CREATE", "OR", "REPLACE", "VIEW"]]


def test_a_plain_table_becomes_a_view(spark, database):
    spark.range(2).toDF("n").write.saveAsTable(f"{database}.plain")
    assert catalog.materialize(spark.range(4).toDF("n"), database, "plain").count() == 4


def test_batch_id_format():
    assert bronze.new_batch_id(AT) == "2024-03-01_12-00-00"


def test_typing(spark):
    schema = schemas.RECORDS["encounters"]
    df = encounters(spark, "2020-01-01T10:00:00-05:00", "2020-01-01", None)
    starts = [r.start_time for r in parsed.cast_to(df, schema).collect()]
    assert starts == [dt.datetime(2020, 1, 1, 10), dt.datetime(2020, 1, 1), None]
    utc = [r.start_time for r in parsed.cast_to(df, schema, tz="UTC").collect()]
    assert utc[0] == dt.datetime(2020, 1, 1, 15)


@pytest.mark.parametrize("text", ["2012", "2012-05", "soon", "2012-13-45"])
def test_unloadable_dates(spark, text):
    schema = schemas.RECORDS["encounters"]
    df = encounters(spark, text, "2020-01-01")
    with pytest.raises(PySparkException):
        parsed.cast_to(df, schema).collect()
    assert [r.start_time for r in parsed.cast_to(df, schema, strict=False).collect()] == [None, dt.datetime(2020, 1, 1)]
    rejected = parsed.rejected_rows(df, schema).collect()
    assert [(r.encounter_id, r.rejected_columns) for r in rejected] == [("e0", ["start_time"])]


def test_reconcile(spark, database):
    df = encounters(spark, None, None)
    bronze.load_bronze(df, "encounters", batch_id="a", database=database)
    table = bronze.source(spark, "encounters", database)
    assert bronze.reconcile(df, table, "a") == (2, 2)
    with pytest.raises(bronze.LoadMismatch):
        bronze.reconcile(df.limit(1), table, "a")


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="observations"):
        parsed.check_inputs(spark, str(tmp_path))


def test_catalog(spark, database):
    bronze.load_bronze(encounters(spark, None), "encounters", batch_id="a", database=database)
    report = {r.table_name: (r.columns, r.rows) for r in catalog.catalog_report(spark, [database]).collect()}
    assert report["bronze_encounters"] == (14, 1) and report["bronze_observations"] == (17, 0) and len(report) == 5
    types = {r.column_name: r.column_type for r in catalog.column_report(bronze.source(spark, "observations", database)).collect()}
    assert types["value_numeric"] == "double" and types["load_timestamp"] == "timestamp_ntz"
    assert "bronze_patients" in catalog.table_ddl(spark, f"{database}.bronze_patients")
    assert catalog.catalog_report(spark, ["no_such_layer"]).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, database):
    df = spark.range(1000).select(F.col("id").cast("string").alias("patient_id"), "id")
    a = catalog.materialize(df, database, "a", "patient_id", 4)
    b = catalog.materialize(df, database, "b", "patient_id", 4)
    plan = a.hint("merge").join(b, "patient_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert a.join(b, "patient_id").count() == 1000


def test_a_hot_key_is_spread_over_several_bucket_files(spark, database):
    """One patient with a third of all rows must not be written by one task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "200KB")
    try:
        df = spark.range(0, 300_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("patient_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        table = catalog.materialize(df, database, "hot", "patient_id", 4)
    finally:
        spark.conf.set(key, before)
    hot = table.filter("patient_id = 'hot'").select(F.col("_metadata.file_path").alias("f"))
    assert hot.count() == 100_000
    assert hot.distinct().count() > 2


def test_shared_dir_follows_the_session(spark):
    root = shared.setting(spark, "spark.checkpoint.dir")
    assert shared.shared_dir(spark, "x").startswith(f"{root}/x-")


def test_jobs_run_together_and_report_failures():
    done = []
    assert shared.run_together([lambda: 1, lambda: 2]) == [1, 2]

    def fail():
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        shared.run_together([fail, lambda: done.append(1)])
    assert done == [1]


def _bundle(number):
    ref = {"subject": {"reference": f"urn:uuid:p{number}"}}
    resources = [
        {"resourceType": "Patient", "id": f"p{number}", "gender": "Male", "birthDate": "1970-01-01"},
        {"resourceType": "Encounter", "id": f"e{number}", "class": {"code": "AMB"}, "period": {"start": "2020-01-01T00:00:00Z"}, **ref},
        {"resourceType": "Condition", "id": f"c{number}", "code": {"coding": [{"code": "44054006", "display": "Diabetes (disorder)"}]}, **ref},
        {"resourceType": "MedicationRequest", "id": f"m{number}", "status": "active", "medicationReference": {"reference": "urn:uuid:d"}, **ref},
        {"resourceType": "Medication", "id": "d", "code": {"coding": [{"code": "1", "display": "Metformin 500" if number % 2 else "Aspirin"}]}},
        {"resourceType": "Observation", "id": f"o{number}", "code": {"coding": [{"code": "4548-4"}]}, "valueQuantity": {"value": 3 + number}, **ref},
    ]
    return json.dumps({"entry": [{"resource": r} for r in resources]})


def test_bundles_to_silver_to_suite(spark, database, tmp_path):
    source, flat = tmp_path / "in", str(tmp_path / "flat")
    source.mkdir()
    for number in range(6):
        (source / f"p{number}.json").write_text(_bundle(number))
    (source / "broken.json").write_text("{")
    staged = bundles.stage_bundles(bundles.require_bundles(bundles.read_bundles(spark, str(source))))
    parsed.write_parsed(flatten_all(staged.resources), flat)
    bronze.load_all(spark, flat, "replace", batch_id="one", ts=AT, database=database)
    bronze.load_all(spark, flat, "append", batch_id="two", ts=AT, database=database)
    sources = {record: bronze.source(spark, record, database) for record in schemas.RECORDS}
    assert all(df.count() == 12 for df in sources.values())
    tables = silver.materialize_silver(sources, "2024-01-01", layer=database, buckets=2)
    assert {name: df.count() for name, df in tables.items()} == dict.fromkeys(silver.MODELS, 6)
    assert tables["silver_patients"].select("load_batch_id").distinct().collect()[0][0] == "two"
    bounds = contract.Bounds(
        row_counts=dict.fromkeys(silver.MODELS, 6), disorder_share=(1, 1), finding_share=(0, 0), unknown_share_below=0.01,
        diabetes_patients=(6, 6), hypertension_patients=(0, 0), heart_failure_patients=(0, 0),
        implausible_hba1c_share=(0.1, 0.2), diabetes_treatment_rate=(0.5, 0.5),
    )
    report = quality.run_suite(spark, tables, contract.distribution_checks(bounds))
    quality.assert_suite(report)
    violations = quality.column_test_report(tables, contract.COLUMN_TESTS).filter("violations > 0").collect()
    assert violations == []


def test_incremental_intake(spark, database, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "hospitalInformation1.json").write_text("{")
    places = dict(folder=str(source), checkpoint=str(tmp_path / "cp"), staging=str(tmp_path / "staging"), run="r", database=database)
    for upto in (2, 5):
        for number in range(upto):
            if not (source / f"p{number}.json").exists():
                (source / f"p{number}.json").write_text(_bundle(number))
        start_intake(spark, **places).awaitTermination()
    patients = bronze.source(spark, "patients", database)
    assert sorted(r.patient_id for r in patients.collect()) == ["p0", "p1", "p2", "p3", "p4"]
    assert patients.select("load_batch_id").distinct().count() == 2
    drugs = bronze.source(spark, "medication_requests", database)
    assert drugs.filter("medication_display IS NULL").count() == 0


def test_column_profile_and_a_table_from_ddl(spark, database):
    bronze.load_bronze(encounters(spark, "2020-01-01", None), "encounters", "replace", "one", AT, database=database)
    table = bronze.bronze_name("encounters", database)
    profile = {r["column_name"]: (r["column_type"], r["rows"], r["non_null"]) for r in catalog.column_profile(spark.table(table)).collect()}
    assert profile["start_time"] == ("timestamp_ntz", 2, 1) and profile["load_batch_id"] == ("string", 2, 2)
    catalog.create_like(spark, table, f"{database}.copy")
    assert spark.table(f"{database}.copy").schema == spark.table(table).schema and spark.table(f"{database}.copy").count() == 0
