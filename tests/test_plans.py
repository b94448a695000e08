"""Plan shapes that decide how the jobs scale."""

import json

import pytest
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.operators import flatten
from fhirlake.plans import analysis, silver
from fhirlake.sources import bundles


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Silver tables as parquet, so that the filters of the reports can reach a scan."""
    folder = tmp_path_factory.mktemp("silver")
    empty = {r: spark.createDataFrame([], schemas.bronze_schema(r)) for r in schemas.RECORDS}
    out = {}
    for name, df in silver.build_silver(empty, "2024-01-01").items():
        df.write.parquet(str(folder / name))
        out[name] = spark.read.parquet(str(folder / name))
    return out


def test_report_filters_and_columns_reach_the_scan(tables):
    conditions, observations = tables["silver_conditions"], tables["silver_observations"]
    plan = executed(analysis.systolic(conditions, observations))
    assert "EqualTo(loinc_code,8480-6)" in plan and "EqualTo(condition_flag,hypertension)" in plan
    for scan in plan.split("ReadSchema: ")[1:]:
        columns = scan.split("\n")[0]
        assert "display" not in columns and "effective_date" not in columns and "onset_date" not in columns


def test_reports_use_no_python_and_no_cross_product(tables):
    conditions, medications = tables["silver_conditions"], tables["silver_medications"]
    observations = tables["silver_observations"]
    reports = [
        analysis.systolic(conditions, observations, control=True),
        analysis.diabetic_hba1c(conditions, observations, True),
        analysis.hba1c_fanout(conditions, observations),
        analysis.treated_patients(conditions, medications, analysis.DIABETES),
        analysis.diabetes_treatment_rate(conditions, medications),
        analysis.chronic_cohorts(conditions),
        analysis.targeted_drugs(tables["silver_medications"]),
    ]
    for report in reports:
        plan = executed(report)
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert "Expand" not in plan


def test_a_sweep_is_one_scan(tables):
    assert executed(analysis.targeted_drugs(tables["silver_medications"])).count("FileScan") == 1
    assert executed(analysis.chronic_cohorts(tables["silver_conditions"])).count("FileScan") == 1


def test_requests_of_one_large_bundle_spread_over_the_join(spark):
    """All rows in one bundle, none needing a lookup: their join keys must still differ."""
    request = {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"coding": [{"code": "1"}]}}
    medication = {"resourceType": "Medication", "id": "m", "code": {"coding": [{"code": "2"}]}}
    resources = spark.range(4000).select(
        F.lit("one").alias("bundle_id"),
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") < 10, "Medication").otherwise("MedicationRequest").alias("resource_type"),
        F.when(F.col("id") < 10, json.dumps(medication)).otherwise(json.dumps(request)).alias("resource"),
    )
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        flat = flatten.flatten_medication_requests(resources)
        assert "SortMergeJoin" in executed(flat)
        sizes = [r["count"] for r in flat.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 3990 and max(sizes) < 1000


def test_limit_reads_only_the_files_it_returns(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i:02d}.json").write_text("{}")
    df = bundles.read_bundles(spark, str(tmp_path), limit=3)
    names = [r.bundle_id.rsplit("/", 1)[-1] for r in df.orderBy("bundle_id").collect()]
    assert names == ["f00.json", "f01.json", "f02.json"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # otherwise the leaves lie inside the adaptive node
    try:
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    leaf = plan.collectLeaves().head()  # the scan of the contents; the others list files
    assert "content" in leaf.schema().simpleString()
    assert leaf.metrics().apply("numFiles").value() == 3


def test_the_envelope_is_decoded_once(spark):
    docs = spark.createDataFrame([("a", "{}")], "bundle_id string, value string").repartition(1)
    decoded = bundles.decode_bundles(docs)
    for df in (bundles.explode_resources(decoded), bundles.quarantine(decoded), bundles.split_bad_bundles(docs)[0]):
        assert executed(df).count("from_json(") == 1
