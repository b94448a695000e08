"""Headline timings on the driver's tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

The stages run one after the other on physical tables, as in production: parsed parquet
-> bronze tables -> silver tables -> checks and reports on the silver tables; and bundle
documents -> staging -> five parsed record sets. Inputs of the first stage are prepared
untimed. Each step runs three times and its best time counts, since the first runs are
spent compiling the generated code. Reports go to the no-op sink, so every row is
computed and none is collected.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import pathlib
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import shapes
from bindings.registry import Data
from fhirlake import schemas
from fhirlake.operators import profile, quality
from fhirlake.operators.dedupe import latest_by
from fhirlake.operators.flatten import SOURCE_TYPES, flatten_all
from fhirlake.plans import analysis as q
from fhirlake.plans import contract
from fhirlake.plans.silver import MODELS, build_silver, materialize_silver
from fhirlake.sources import bronze, bundles, catalog, parsed


# Fixed, since a time is a constant in the generated code and a new one means new code.
LOADED_AT = dt.datetime(2024, 3, 1, 12, 0, 0)


def session(cpus: str, scratch: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    """Best of three runs."""
    times = []
    for _ in range(3):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return min(times)


def prepare(data: Data, folder: str, files: int) -> tuple[int, int]:
    """Parsed records (dates as ISO text) and bundle documents, each in several files."""
    rows = 0
    for record in schemas.RECORDS:
        df = data.bronze(record).repartition(files)
        text = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.parsed_schema(record).fields]
        parsed.write_parsed({record: df.select(*text)}, folder)
        rows += parsed.read_parsed(data.spark, folder, record).count()
    data.bundles().repartition(files).write.parquet(f"{folder}/documents")
    return rows, data.spark.read.parquet(f"{folder}/documents").count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = session(cpus, scratch)
    timings, rows, documents = stages(spark, sf_dir, f"{scratch}/bench", cpus)
    print(
        json.dumps(
            {
                "metric": "total seconds of bundle flattening, bronze load, silver build and reports",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in timings.items()},
                "sf": pathlib.Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "bronze_rows": rows,
                "bronze_rows_per_sec": round(rows / timings["bronze_load"]),
                "bundles": documents,
                "bundles_per_sec": round(documents / timings["flatten_bundles"]),
            }
        )
    )
    spark.stop()


def stages(spark: SparkSession, sf_dir: str, scratch: str, cpus: str) -> tuple[dict[str, float], int, int]:
    """Seconds per step, bronze rows and bundle documents."""
    folder = f"{scratch}/parsed"
    rows, documents = prepare(Data(spark, sf_dir), folder, int(cpus))
    timings: dict[str, float] = {}

    # Bundles -> staging -> parsed record sets.
    def flatten() -> None:
        documents_in = spark.read.parquet(f"{folder}/documents")
        staged = bundles.stage_bundles(documents_in, f"{scratch}/staged", SOURCE_TYPES)
        parsed.write_parsed(flatten_all(staged.resources), f"{scratch}/flat")

    timings["flatten_bundles"] = timed(flatten)

    # Parsed -> bronze, reconciled -> silver tables.
    timings["bronze_load"] = timed(lambda: bronze.load_all(spark, folder, batch_id="bench", ts=LOADED_AT))
    sources = {record: bronze.source(spark, record) for record in schemas.RECORDS}
    for name, model in build_silver(sources, shapes.AS_OF).items():
        timings[name] = timed(lambda m=model, n=name: catalog.materialize(m, "silver", n))
    timings["silver_together"] = timed(lambda: materialize_silver(sources, shapes.AS_OF))

    silver = {name: spark.table(f"silver.{name}") for name in MODELS}
    conditions, medications = silver["silver_conditions"], silver["silver_medications"]
    observations = silver["silver_observations"]
    drugs = bronze.source(spark, "medication_requests")
    lines = shapes.table(spark, sf_dir, "lineitem")
    reports = {
        "W01_latest_by": lambda: latest_by(
            lines, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_extendedprice"]
        ),
        "D01_D04_column_tests": lambda: quality.column_test_report(silver, contract.COLUMN_TESTS),
        "D05_range_checks": lambda: quality.suite_report(silver, contract.distribution_checks()),
        "Q02_top_conditions": lambda: q.top_conditions(bronze.source(spark, "conditions")),
        "Q05c_condition_flags": lambda: q.flag_distribution(conditions, "condition_flag"),
        "Q07c_targeted_drugs": lambda: q.targeted_drugs(drugs),
        "Q08c_drug_classes": lambda: profile.distribution(medications, "drug_class"),
        "Q09a_treated_diabetes_t2": lambda: q.treated_patients(conditions, medications, q.DIABETES),
        "Q12_hba1c_fanout": lambda: q.hba1c_fanout(conditions, observations),
        "Q16_hba1c_by_unit": lambda: q.hba1c_by_unit(observations),
        "Q17_hba1c_bands": lambda: q.hba1c_bands(observations),
        "Q18_diabetic_hba1c": lambda: q.diabetic_hba1c(conditions, observations, False),
        "Q19_htn_systolic": lambda: q.systolic(conditions, observations),
        "Q20_control_systolic": lambda: q.systolic(conditions, observations, control=True),
        "Q21b_top_codes": lambda: q.top_observation_codes(bronze.source(spark, "observations")),
        "Q22_category_shares": lambda: q.category_shares(conditions),
        "Q23_chronic_cohorts": lambda: q.chronic_cohorts(conditions),
        "Q25_diabetes_treatment_rate": lambda: q.diabetes_treatment_rate(conditions, medications),
    }
    for name, build in reports.items():
        timings[name] = timed(lambda b=build: run(b()))
    return timings, rows, documents


if __name__ == "__main__":
    main()
