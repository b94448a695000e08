"""Filters, joins, aggregates, windows, set operations, scalar functions (F, J, A, W, U, X)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindings import oracle
from bindings.registry import register
from fhirlake.functions import classify, dates, paths, rules
from fhirlake.operators import cohorts, dedupe, profile, quality



def _diabetic() -> Column:
    return F.col("condition_flag") == "diabetes_t2"


def _hypertensive() -> Column:
    return F.col("condition_flag") == "hypertension"


# --- F: projections, filters, predicates ---

register(
    "F01_select_rename",
    lambda d: d.bronze("conditions").select("condition_id", F.col("code").alias("snomed_code"), "load_batch_id"),
    "SELECT condition_id, code AS snomed_code, load_batch_id FROM bronze_conditions",
)
register(
    "F02_code_in",
    lambda d: d.bronze("conditions")
    .filter(classify.code_in(F.col("code"), ["44054006", "59621000"]))
    .select("condition_id", "code", "load_batch_id"),
    "SELECT condition_id, code, load_batch_id FROM bronze_conditions WHERE code IN ('44054006', '59621000')",
)
register(
    "F03_null_tests",
    lambda d: d.bronze("medication_requests")
    .filter(F.col("medication_display").isNull())
    .select("medication_request_id", F.col("code_system").isNotNull().alias("is_coded"), "load_batch_id"),
    "SELECT medication_request_id, code_system IS NOT NULL AS is_coded, load_batch_id "
    "FROM bronze_medication_requests WHERE medication_display IS NULL",
)
register(
    "F04_suffix_match",
    lambda d: d.bronze("conditions").select(
        "condition_id", "load_batch_id",
        classify.suffix_match(F.col("display"), "(disorder)", "(finding)").alias("matches"),
    ),
    "SELECT condition_id, load_batch_id, display ILIKE '%(disorder)' OR display ILIKE '%(finding)' AS matches "
    "FROM bronze_conditions",
)
register(
    "F05_contains_any",
    lambda d: d.bronze("medication_requests").select(
        "medication_request_id", "load_batch_id",
        classify.contains_any(F.col("medication_display"), ["Metformin", "lisinopril"]).alias("matches"),
    ),
    "SELECT medication_request_id, load_batch_id, medication_display ILIKE '%metformin%' "
    "OR medication_display ILIKE '%lisinopril%' AS matches FROM bronze_medication_requests",
)
register(
    "F06_range_rule",
    lambda d: d.bronze("observations").select(
        "observation_id", "load_batch_id",
        classify.range_rule(F.col("loinc_code"), F.col("value_numeric"), (rules.SYSTOLIC, ">=", 60)).alias("fires"),
    ),
    "SELECT observation_id, load_batch_id, loinc_code = '8480-6' AND value_numeric >= 60 AS fires "
    "FROM bronze_observations",
)
register(
    "F07_boolean_predicates",
    lambda d: d.silver("observations")
    .filter(F.col("is_critical_value") & (F.col("is_numeric") != ~F.col("is_plausible_value")))
    .select("observation_id", "value_numeric"),
    "SELECT observation_id, value_numeric FROM silver_observations "
    "WHERE is_critical_value AND is_numeric <> (NOT is_plausible_value)",
)
register(
    "F08_conjunctive_filter",
    lambda d: d.silver("observations")
    .filter((F.col("loinc_code") == rules.SYSTOLIC) & F.col("is_plausible_value") & F.col("value_numeric").isNotNull())
    .select("observation_id", "patient_id", "value_numeric"),
    "SELECT observation_id, patient_id, value_numeric FROM silver_observations "
    "WHERE loinc_code = '8480-6' AND is_plausible_value AND value_numeric IS NOT NULL",
)
_DRUGS = ", ".join(f"('{w}')" for w in rules.TARGETED_DRUGS)
_SWEEP = (
    f"SELECT word, count(medication_display) AS n FROM (VALUES {_DRUGS}) w(word) "
    "LEFT JOIN bronze_medication_requests ON contains(lower(medication_display), word) GROUP BY word"
)
register(
    "F09_predicate_sweep",
    lambda d: profile.count_matching(d.bronze("medication_requests"), "medication_display", rules.TARGETED_DRUGS),
    _SWEEP,
)

# --- J: joins ---

register(
    "J01_in_cohort",
    lambda d: cohorts.in_cohort(d.silver("observations"), cohorts.members(d.silver("conditions"), _diabetic())).select(
        "observation_id", "patient_id", "value_numeric"
    ),
    "SELECT observation_id, patient_id, value_numeric FROM silver_observations WHERE patient_id IN "
    "(SELECT patient_id FROM silver_conditions WHERE condition_flag = 'diabetes_t2')",
)
register(
    "J02_control_group",
    lambda d: cohorts.not_in_cohort(d.silver("observations"), cohorts.members(d.silver("conditions"), _hypertensive())).select(
        "observation_id", "patient_id", "value_numeric"
    ),
    "SELECT observation_id, patient_id, value_numeric FROM silver_observations o WHERE NOT EXISTS "
    "(SELECT 1 FROM silver_conditions c WHERE c.patient_id = o.patient_id AND c.condition_flag = 'hypertension')",
)
register(
    "J03_cohort_overlap",
    lambda d: cohorts.cohort_overlap(
        d.silver("conditions").filter(F.col("condition_flag") == "copd"),
        d.silver("medications").filter("medication_flag = 'copd_drug'"),
    ),
    "SELECT count(DISTINCT c.patient_id) AS patients FROM silver_conditions c "
    "JOIN (SELECT DISTINCT patient_id FROM silver_medications WHERE medication_flag = 'copd_drug') m USING (patient_id) "
    "WHERE c.condition_flag = 'copd'",
)
register(
    "J04_fanout_stats",
    lambda d: cohorts.fanout_stats(
        d.silver("conditions").filter(F.col("condition_flag").isNotNull()), d.silver("observations"), "value_numeric"
    ),
    "SELECT count(DISTINCT o.patient_id) AS patients, count(*) AS readings, round(avg(o.value_numeric), 2) AS avg_value, "
    "round(min(o.value_numeric), 2) AS min_value, round(max(o.value_numeric), 2) AS max_value "
    "FROM silver_conditions c JOIN silver_observations o ON o.patient_id = c.patient_id WHERE c.condition_flag IS NOT NULL",
)
register(
    "J05_using_join",
    lambda d: d.silver("encounters").join(d.silver("patients"), "patient_id").select(
        "patient_id", "encounter_id", "encounter_type", "age_group"
    ),
    "SELECT patient_id, encounter_id, encounter_type, age_group FROM silver_encounters JOIN silver_patients USING (patient_id)",
)
register(
    "J06_orphan_keys",
    lambda d: quality.orphan_keys(d.silver("encounters"), d.some_patients(), "patient_id"),
    "SELECT patient_id, count(*) AS n FROM silver_encounters WHERE patient_id IS NOT NULL "
    "AND patient_id NOT IN (SELECT patient_id FROM some_patients) GROUP BY patient_id",
)
_RATE = (
    "SELECT count(*) AS patients, count(t.patient_id) AS treated_patients, "
    "round(count(t.patient_id) * 1.0 / nullif(count(*), 0), 6) AS rate "
    "FROM (SELECT DISTINCT patient_id FROM silver_conditions WHERE condition_flag = '{condition}') c "
    "LEFT JOIN (SELECT DISTINCT patient_id FROM silver_medications WHERE medication_flag = '{drug}') t USING (patient_id)"
)
register(
    "J08_scalar_ratio",
    lambda d: cohorts.treatment_rate(
        d.silver("conditions"), d.silver("medications"), _hypertensive(), F.col("medication_flag") == "antihypertensive"
    ).withColumn("rate", F.round("rate", 6)),
    _RATE.format(condition="hypertension", drug="antihypertensive"),
)

# --- A: aggregations ---

register("A01_row_count", lambda d: profile.row_count(d.bronze("observations")), "SELECT count(*) AS n FROM bronze_observations")
register(
    "A02_key_uniqueness",
    lambda d: profile.key_uniqueness(d.bronze("conditions"), "condition_id"),
    "SELECT count(*) AS n, count(DISTINCT condition_id) AS unique_keys FROM bronze_conditions",
)
register(
    "A03_distribution",
    lambda d: profile.distribution(d.bronze("encounters"), "class_code"),
    "SELECT class_code, count(*) AS n FROM bronze_encounters GROUP BY class_code",
)
register(
    "A04_distribution_distinct",
    lambda d: profile.distribution(d.bronze("conditions"), "code", distinct="patient_id"),
    "SELECT code, count(*) AS n, count(DISTINCT patient_id) AS patients FROM bronze_conditions GROUP BY code",
)
register(
    "A05_distribution_columns",
    lambda d: profile.distribution(d.bronze("observations"), "loinc_code", "unit"),
    "SELECT loinc_code, unit, count(*) AS n FROM bronze_observations GROUP BY loinc_code, unit",
)
register(
    "A06_share",
    lambda d: profile.share(
        d.silver("conditions"), {"active": F.col("is_active"), "billable": F.col("is_billable_diagnosis")}, 6
    ),
    "SELECT round(count(*) FILTER (WHERE is_active) * 1.0 / count(*), 6) AS active, "
    "round(count(*) FILTER (WHERE is_billable_diagnosis) * 1.0 / count(*), 6) AS billable FROM silver_conditions",
)
_SHAPE_COUNTS = (
    "SELECT count(*) AS total, count(value_numeric) AS numeric_rows, count(value_text) AS text_rows, "
    "count(value_code) AS coded_rows, count(parent_observation_id) AS component_rows FROM bronze_observations"
)
register("A07_value_shape_counts", lambda d: profile.value_shape_counts(d.bronze("observations")), _SHAPE_COUNTS)
register(
    "A08_numeric_summary",
    lambda d: profile.numeric_summary(d.bronze("observations"), "value_numeric", "loinc_code", 1),
    "SELECT loinc_code, count(*) AS n, round(min(value_numeric), 1) AS min_value, round(avg(value_numeric), 1) AS avg_value, "
    "round(max(value_numeric), 1) AS max_value FROM bronze_observations GROUP BY loinc_code",
)
register(
    "A09_treatment_rate",
    lambda d: cohorts.treatment_rate(
        d.silver("conditions"), d.silver("medications"),
        F.col("condition_flag") == "heart_failure", F.col("medication_flag") == "heart_failure_drug",
    ).withColumn("rate", F.round("rate", 6)),
    _RATE.format(condition="heart_failure", drug="heart_failure_drug"),
)
register(
    "A10_cohort",
    lambda d: cohorts.cohort(d.silver("conditions"), F.col("condition_flag") == "copd"),
    "SELECT DISTINCT patient_id FROM silver_conditions WHERE condition_flag = 'copd'",
)
register(
    "A11_band_counts",
    lambda d: profile.band_counts(d.bronze("observations"), "value_numeric", rules.HBA1C_EDGES, rules.HBA1C_LABELS),
    f"SELECT {oracle.band_sql('value_numeric')} AS band, count(*) AS n FROM bronze_observations "
    "WHERE value_numeric IS NOT NULL GROUP BY 1",
)
register(
    "A12_null_counts",
    lambda d: profile.null_counts(d.bronze("medication_requests"), ["medication_display", "code_system", "dosage_text"]),
    "SELECT count(*) AS n, count(*) - count(medication_display) AS medication_display_nulls, "
    "count(*) - count(code_system) AS code_system_nulls, count(*) - count(dosage_text) AS dosage_text_nulls "
    "FROM bronze_medication_requests",
)
register(
    "A13_pair_balance",
    lambda d: profile.pair_balance(d.bronze("observations"), "loinc_code", rules.SYSTOLIC, rules.DIASTOLIC),
    "SELECT a AS first_rows, b AS second_rows, a = b AS balanced FROM (SELECT "
    "count(*) FILTER (WHERE loinc_code = '8480-6') AS a, count(*) FILTER (WHERE loinc_code = '8462-4') AS b "
    "FROM bronze_observations)",
)
register(
    "A14_rows_per_entity",
    lambda d: cohorts.rows_per_entity(d.silver("conditions"), _diabetic()),
    "SELECT count(*) AS rows, count(DISTINCT patient_id) AS patients, "
    "round(count(*) * 1.0 / count(DISTINCT patient_id), 2) AS rows_per_patient "
    "FROM silver_conditions WHERE condition_flag = 'diabetes_t2' AND patient_id IS NOT NULL",
)
register(
    "A14_flagged_share",
    lambda d: cohorts.flagged_share(d.silver("conditions"), _diabetic(), d.silver("patients")),
    "SELECT count(*) AS patients, count(*) FILTER (WHERE f) AS flagged_patients, "
    "round(count(*) FILTER (WHERE f) * 1.0 / count(*), 4) AS share FROM (SELECT patient_id, patient_id IN "
    "(SELECT patient_id FROM silver_conditions WHERE condition_flag = 'diabetes_t2') AS f FROM silver_patients)",
)

# --- W, U: windows, sorts, set operations ---

register(
    "W01_latest_by",
    lambda d: dedupe.latest_by(
        d.table("lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_extendedprice"]
    ),
    "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1",
)
register(
    "W02_top_k",
    lambda d: profile.top_k(d.bronze("conditions"), ["code", "display"], 15),
    "SELECT code, display, count(*) AS n FROM bronze_conditions GROUP BY code, display "
    "ORDER BY n DESC, code NULLS LAST, display NULLS LAST LIMIT 15",
)
register(
    "W03_order_by_count",
    lambda d: profile.distribution(d.bronze("medication_requests"), "medication_display"),
    "SELECT medication_display, count(*) AS n FROM bronze_medication_requests GROUP BY 1",
)
register(
    "W04_order_by_label",
    lambda d: d.bronze("encounters").groupBy("class_display").agg(F.count(F.lit(1)).alias("n"))
    .orderBy(F.asc_nulls_last("class_display")),
    "SELECT class_display, count(*) AS n FROM bronze_encounters GROUP BY 1 ORDER BY 1",
)
register(
    "W05_limit",
    lambda d: profile.sample_rows(d.bronze("encounters"), 7, ["encounter_id", "load_batch_id"]),
    "SELECT * FROM bronze_encounters ORDER BY encounter_id, load_batch_id LIMIT 7",
)
_UNION = " UNION ALL ".join(
    f"SELECT 'bronze_{r}' AS table_name, count(*) AS n FROM bronze_{r}"
    for r in ("patients", "encounters", "conditions", "medication_requests", "observations")
)
register(
    "U01_layer_row_counts",
    lambda d: profile.layer_row_counts(
        {f"bronze_{r}": d.bronze(r) for r in
         ("patients", "encounters", "conditions", "medication_requests", "observations")}
    ),
    _UNION,
)
register(
    "U02_distinct",
    lambda d: d.bronze("conditions").select("patient_id").distinct(),
    "SELECT DISTINCT patient_id FROM bronze_conditions",
)

# --- X: scalar functions ---

register(
    "X01_lower",
    lambda d: d.bronze("patients").select("patient_id", "load_batch_id", F.lower("gender").alias("gender")),
    "SELECT patient_id, load_batch_id, lower(gender) AS gender FROM bronze_patients",
)
register(
    "X02_ilike_like",
    lambda d: d.bronze("medication_requests").select(
        "medication_request_id", "load_batch_id",
        F.col("medication_display").ilike("%insulin%").alias("ilike"),
        F.lower("medication_display").like("%insulin%").alias("like_lower"),
    ),
    "SELECT medication_request_id, load_batch_id, medication_display ILIKE '%insulin%' AS ilike, "
    "lower(medication_display) LIKE '%insulin%' AS like_lower FROM bronze_medication_requests",
)
register(
    "X03_coalesce",
    lambda d: d.bronze("conditions").select(
        "condition_id", "load_batch_id", F.coalesce("clinical_status", F.lit("active")).alias("status")
    ),
    "SELECT condition_id, load_batch_id, coalesce(clinical_status, 'active') AS status FROM bronze_conditions",
)
register(
    "X04_case",
    lambda d: d.bronze("encounters").select(
        "encounter_id", "load_batch_id",
        rules.encounter_type(F.col("class_code")).alias("simple_case"),
        F.when(F.col("end_time").isNull(), "open").when(F.col("start_time").isNull(), "odd")
        .otherwise("closed").alias("searched_case"),
    ),
    f"SELECT encounter_id, load_batch_id, {oracle.encounter_type_sql()} AS simple_case, CASE WHEN end_time IS NULL THEN 'open' "
    "WHEN start_time IS NULL THEN 'odd' ELSE 'closed' END AS searched_case FROM bronze_encounters",
)
register(
    "X05_date_diff",
    lambda d: d.bronze("encounters").select(
        "encounter_id", "load_batch_id",
        dates.years_between(F.col("start_time"), F.col("end_time")).alias("years"),
        dates.minutes_between(F.col("start_time"), F.col("end_time")).alias("minutes"),
        dates.days_between(F.col("start_time"), F.col("end_time")).alias("days"),
    ),
    "SELECT encounter_id, load_batch_id, date_diff('year', start_time, end_time) AS years, "
    "date_diff('minute', start_time, end_time) AS minutes, "
    "date_diff('day', cast(start_time AS date), cast(end_time AS date)) AS days FROM bronze_encounters",
)
register(
    "X06_age_as_of",
    lambda d: d.silver("patients").select("patient_id", "age_years_current", "age_group"),
    "SELECT patient_id, age_years_current, age_group FROM silver_patients",
)
register(
    "X07_timestamp_to_date",
    lambda d: d.bronze("encounters").select(
        "encounter_id", "load_batch_id", F.col("start_time").cast("date").alias("start_date")
    ),
    "SELECT encounter_id, load_batch_id, cast(start_time AS date) AS start_date FROM bronze_encounters",
)
register(
    "X08_round",
    lambda d: d.table("events").select("event_id", F.round("value", 1).alias("rounded")),
    "SELECT event_id, round(value, 1) AS rounded FROM events",
)
register(
    "X09_aggregates",
    lambda d: d.bronze("observations").groupBy("loinc_code").agg(
        F.count("value_numeric").alias("n"), F.round(F.sum("value_numeric"), 2).alias("total"),
        F.round(F.avg("value_numeric"), 4).alias("mean"), F.min("value_numeric").alias("low"),
        F.max("value_numeric").alias("high"),
        F.round(F.try_divide(F.count("value_numeric").cast("double"), F.count(F.lit(1))), 4).alias("filled"),
    ),
    "SELECT loinc_code, count(value_numeric) AS n, round(sum(value_numeric), 2) AS total, round(avg(value_numeric), 4) AS mean, "
    "min(value_numeric) AS low, max(value_numeric) AS high, round(1.0 * count(value_numeric) / count(*), 4) AS filled "
    "FROM bronze_observations GROUP BY loinc_code",
)
register(
    "X10_strings",
    lambda d: d.bronze("encounters").select(
        "encounter_id", "load_batch_id",
        F.array_join(F.array("class_code", "type_code"), " ").alias("joined"),
        F.col("class_display").startswith("1-").alias("starts"),
        F.col("class_display").endswith("GH").alias("ends"),
        F.substring_index("class_display", "-", -1).alias("after_last"),
    ),
    "SELECT encounter_id, load_batch_id, concat_ws(' ', class_code, type_code) AS joined, starts_with(class_display, '1-') AS starts, "
    "ends_with(class_display, 'GH') AS ends, split_part(class_display, '-', -1) AS after_last FROM bronze_encounters",
)
register(
    "X11_json_fields",
    lambda d: d.table("events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.from_json("props", "k long").getField("k").alias("typed_k"),
        F.size(F.json_object_keys("props")).cast("long").alias("keys"),
    ),
    "SELECT event_id, cast(props->>'$.k' AS bigint) AS k, cast(props->'$.k' AS bigint) AS typed_k, "
    "cast(len(json_keys(props)) AS bigint) AS keys FROM events",
)
register(
    "X12_array_access",
    lambda d: d.bronze("encounters")
    .select("encounter_id", "load_batch_id", F.split("class_display", "-").alias("words"))
    .select(
        "encounter_id", "load_batch_id",
        paths.get_path(F.col("words"), 1).alias("second"), paths.get_path(F.col("words"), 9).alias("tenth"),
        F.transform("words", lambda w, i: F.concat(i.cast("string"), w)).getItem(0).alias("numbered"),
        F.exists("words", lambda w: w == "HIGH").alias("has_high"),
    ),
    "SELECT encounter_id, load_batch_id, words[2] AS second, words[10] AS tenth, '0' || words[1] AS numbered, "
    "list_contains(words, 'HIGH') AS has_high "
    "FROM (SELECT encounter_id, load_batch_id, string_split(class_display, '-') AS words FROM bronze_encounters)",
)
register(
    "X13_concat_index",
    lambda d: d.bronze("observations").select(
        "load_batch_id", F.concat("observation_id", F.lit("_"), F.lit(0).cast("string")).alias("part_id")
    ),
    "SELECT load_batch_id, observation_id || '_0' AS part_id FROM bronze_observations",
)
register(
    "X14_batch_label",
    lambda d: d.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("label")),
    "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS label FROM events",
)
