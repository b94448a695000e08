import datetime as dt

from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.operators.dedupe import latest_by
from fhirlake.plans import silver

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def bronze(spark, record, *records):
    """Bronze rows from partial dicts."""
    schema = schemas.bronze_schema(record)
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in records], schema)


def test_latest_by_prefers_time_then_batch(spark, rows):
    df = spark.createDataFrame(
        [("a", T1, "b1", 1), ("a", T2, "b0", 2), ("b", T1, "b1", 3), ("b", T1, "b2", 4), ("c", None, "b1", 5),
         ("c", T1, "b1", 6), (None, T1, "b1", 7), (None, T2, "b1", 8)],
        "k string, load_timestamp timestamp_ntz, load_batch_id string, v int",
    )
    assert [(r["k"], r["v"]) for r in rows(latest_by(df, "k"))] == [("a", 2), ("b", 4), ("c", 6), (None, 8)]


def test_latest_by_with_a_hot_key(spark):
    """A key with a third of all rows: at most one row per task may be shuffled for it."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("load_timestamp"),
        F.lit("b").alias("load_batch_id"),
        "id",
    )
    result = latest_by(df, "k")
    assert result.count() == 20_001
    assert result.filter("k = 'hot'").first().id == 29_997
    plan = result._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_patients(spark, rows):
    born = dt.date(2000, 12, 31)
    df = bronze(
        spark, "patients",
        dict(patient_id="a", gender="MALE", birth_date=born, load_timestamp=T1),
        dict(patient_id="b", birth_date=dt.date(1950, 1, 1), deceased_date=dt.datetime(2000, 1, 1, 5), load_timestamp=T1),
        dict(patient_id="c", load_timestamp=T1),
    )
    a, b, c = sorted(rows(silver.silver_patients(df, "2001-01-01")), key=lambda r: r["patient_id"])
    assert (a["gender"], a["age_years_current"], a["age_group"], a["is_deceased"], a["age_at_death"]) == ("male", 1, "pediatric", False, None)
    assert (b["is_deceased"], b["age_at_death"], b["age_group"]) == (True, 50, "adult_middle")
    assert (c["age_years_current"], c["age_group"]) == (None, "senior")


def test_encounters(spark, rows):
    df = bronze(
        spark, "encounters",
        dict(encounter_id="a", class_code="IMP", start_time=dt.datetime(2024, 1, 1, 0, 0, 59), end_time=dt.datetime(2024, 1, 1, 0, 1), load_timestamp=T1),
        dict(encounter_id="b", class_code="XX", start_time=dt.datetime(2024, 1, 1, 23, 59), end_time=dt.datetime(2024, 1, 2, 0, 1), load_timestamp=T1),
        dict(encounter_id="c", start_time=T1, load_timestamp=T1),
    )
    got = {r["encounter_id"]: r for r in rows(silver.silver_encounters(df))}
    assert (got["a"]["duration_minutes"], got["a"]["length_of_stay_days"], got["a"]["is_inpatient"]) == (1, 0, True)
    assert (got["b"]["duration_minutes"], got["b"]["length_of_stay_days"], got["b"]["encounter_type"]) == (2, 1, "other")
    assert (got["c"]["duration_minutes"], got["c"]["length_of_stay_days"], got["c"]["is_inpatient"]) == (None, None, None)
    assert "class_display" not in got["a"]


def test_medications_keep_null_activity(spark, rows):
    df = bronze(
        spark, "medication_requests",
        dict(medication_request_id="a", status="Active", load_timestamp=T1),
        dict(medication_request_id="b", status=None, load_timestamp=T1),
        dict(medication_request_id="c", status="completed", load_timestamp=T1),
    )
    assert [r["is_active"] for r in rows(silver.silver_medications(df))] == [True, None, False]


def test_models_have_exactly_one_exchange(spark):
    for name, (record, build) in silver.MODELS.items():
        plan = build(bronze(spark, record, {}))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, name
        assert "Python" not in plan, name


def test_columns_prune_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "b")
    bronze(spark, "conditions", {"condition_id": "a", "load_timestamp": T1}).write.parquet(path)
    df = silver.silver_conditions(spark.read.parquet(path)).select("patient_id", "condition_flag")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scanned = plan[plan.index("ReadSchema"):]
    assert "display" not in scanned and "onset_date" not in scanned
