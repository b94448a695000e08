from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.operators.dedupe import latest_by
from fhirlake.sources import bronze, latest, parsed

SCHEMA = "k string, v int, load_timestamp timestamp_ntz, load_batch_id string"


def at(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture
def table(spark):
    name = f"l{uuid.uuid4().hex[:8]}"
    latest.create_latest(spark, name, spark.createDataFrame([], SCHEMA), "k", 8)
    yield name
    spark.sql(f"DROP TABLE {name}")


BATCHES = [
    [("a", 1, at(1), "one"), ("b", 2, at(1), "one"), (None, 3, at(1), "one"), ("a", 9, at(1), "old")],
    [("a", 4, at(2), "two"), ("c", 5, at(2), "two"), ("c", 6, at(1), "two"), (None, 7, at(3), "two"), ("hot", 0, at(2), "two")],
    [("b", 8, at(1), "zero"), ("hot", 1, None, "three")] + [("hot", n, at(3), "three") for n in (5, 5)],
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 1, 2, 2)])
def test_increments_equal_a_rebuild(spark, table, order):
    for n in order:
        latest.merge_latest(table, spark.createDataFrame(BATCHES[n], SCHEMA))
    every = spark.createDataFrame(sum(BATCHES, []), SCHEMA)
    expected = latest_by(every, "k")
    assert sorted(map(str, latest.latest(spark, table).collect())) == sorted(map(str, expected.collect()))


def test_only_touched_buckets_are_read_and_written(spark, table):
    many = spark.createDataFrame([(f"k{n}", n, at(1), "one") for n in range(200)], SCHEMA)
    assert latest.merge_latest(table, many) == list(range(8))
    files = lambda: {r[0] for r in spark.table(table).select(F.col("_metadata.file_path")).distinct().collect()}
    before = files()
    few = spark.createDataFrame([("k1", -1, at(2), "two"), ("new", -2, at(2), "two")], SCHEMA)
    touched = latest.merge_latest(table, few)
    assert 1 <= len(touched) <= 2
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before ^ files()}
    assert changed == {str(t) for t in touched}
    old = spark.table(table).filter(F.col("_bucket").isin(touched))
    plan = old._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numPartitions").value() == len(touched)
    assert latest.latest(spark, table).count() == 201
    assert latest.merge_latest(table, few.limit(0)) == []


def test_merging_moves_one_row_per_key_of_the_batch(spark):
    old, batch = (spark.createDataFrame([("a", n, at(1), "x") for n in range(3)], SCHEMA) for _ in range(2))
    plan = latest.merged(old, batch, ["k"], "load_timestamp", ["load_batch_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_a_merge_writes_the_batch_and_the_buckets_once(spark, table, monkeypatch):
    written, given = [], latest.through_table
    monkeypatch.setattr(latest, "through_table", lambda df, purpose, *a, **b: written.append(purpose) or given(df, purpose, *a, **b))
    rows = [(f"k{n % 150}", n, at(1 + n % 9), "one") for n in range(600)]
    latest.merge_latest(table, spark.createDataFrame(rows, SCHEMA))
    assert written == ["latest-batch"]


def test_large_buckets_are_merged_in_parts(spark, table, monkeypatch):
    monkeypatch.setattr(latest, "PART_ROWS", 5)
    rows = [(f"k{n % 150}" if n % 7 else None, n, at(1 + n % 9), f"b{n}") for n in range(600)]
    for some in (rows[:400], rows[300:], rows[:10]):
        latest.merge_latest(table, spark.createDataFrame(some, SCHEMA))
    expected = latest_by(spark.createDataFrame(rows, SCHEMA), "k")
    assert sorted(map(str, latest.latest(spark, table).collect())) == sorted(map(str, expected.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would put such small parts in one task
    latest.merge_latest(table, spark.createDataFrame(rows, SCHEMA))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.table(table).groupBy("_bucket").agg(F.countDistinct("_metadata.file_path").alias("n"))
    assert files.agg(F.max("n")).first()[0] > 1


def test_a_lost_row_made_up_by_a_doubled_one_is_a_mismatch(spark):
    names = schemas.RECORDS["conditions"].names
    source = spark.createDataFrame([tuple(f"{c}{n}" if c != "code" or n else None for c in names) for n in range(4)], ", ".join(f"{c} string" for c in names))
    stamped = bronze.stamp_audit(source, "b", at(1))

    def status(table):
        return bronze.batch_content(source, table, "b").first().asDict()

    assert status(stamped.repartition(3)) == {"source_rows": 4, "loaded_rows": 4, "status": "OK"}
    swapped = stamped.filter("condition_id <> 'condition_id1'").unionByName(stamped.filter("condition_id = 'condition_id2'"))
    assert status(swapped) == {"source_rows": 4, "loaded_rows": 4, "status": "MISMATCH"}
    moved = stamped.withColumns({"code": F.coalesce("code", "display"), "display": F.when(F.col("code").isNull(), None).otherwise(F.col("display"))})
    assert status(moved)["status"] == "MISMATCH"  # the same values, a null in another column
    assert status(stamped.withColumn("load_batch_id", F.lit("other"))) == {"source_rows": 4, "loaded_rows": 0, "status": "MISMATCH"}
    with pytest.raises(bronze.LoadMismatch):
        bronze.reconcile(source, swapped, "b", by_content=True)
    assert bronze.reconcile(source, swapped, "b") == (4, 4)


def test_typing_and_rejects_share_one_scan(spark, tmp_path):
    schema = schemas.RECORDS["encounters"]
    rows = [(f"e{n}", "2020-01-01T10:00:00Z" if n % 3 else "never", None if n % 2 else "20x") for n in range(30)]
    given = spark.createDataFrame(rows, "encounter_id string, start_time string, end_time string")
    columns = [F.col(c) if c in given.columns else F.lit(None).cast("string").alias(c) for c in schema.names]
    given.select(*columns, F.lit(7).alias("rejected")).write.parquet(str(tmp_path / "given"))
    df = spark.read.parquet(str(tmp_path / "given"))
    found = parsed.type_once(df, schema)
    lines = lambda d: sorted(map(str, d.collect()))
    assert lines(found.rows) == lines(parsed.cast_to(df, schema, strict=False))
    assert lines(found.rejected) == lines(parsed.rejected_rows(df, schema))
    assert found.rejected.count() == 20 and found.rejected.columns == [*df.columns, "rejected_columns"]
    plan = found.rejected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rejected" in plan or "PartitionFilters: [rejected" in plan


def test_a_lenient_load_reads_its_input_once(spark, tmp_path, monkeypatch):
    database = f"b{uuid.uuid4().hex[:8]}"
    for record in schemas.RECORDS:
        one = spark.createDataFrame([("x1",)], f"{schemas.parsed_schema(record).names[0]} string")
        wanted = schemas.parsed_schema(record)
        kept = [F.col(f.name) if f.name in one.columns else F.lit("bad" if "date" in f.name else None).cast(f.dataType).alias(f.name) for f in wanted.fields]
        one.select(*kept).write.parquet(parsed.record_path(str(tmp_path), record))
    batch = bronze.load_all(spark, str(tmp_path), "append", "b1", at(1), strict=False, database=database, by_content=True)
    assert batch == "b1" and bronze.source(spark, "patients", database).count() == 1
    lost = spark.read.parquet(parsed.record_path(f"{tmp_path}/rejected", "patients")).first()
    assert lost["rejected_columns"] == ["birth_date", "deceased_date"] and lost["birth_date"] == "bad"
    spark.sql(f"DROP DATABASE {database} CASCADE")
