"""Flatten typed resources into the five record sets.

Input is ``(bundle_id, pos, resource_type, resource)``. All are map-only if requests carry the medication
they refer to (``linked``), as `bundles.explode_resources` and `bundles.stage_bundles` give them. Without that column
requests and medications are joined; the join moves flat columns, never JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.functions.paths import get_path, normalize_ref, us_core_display

# Url endings of the demographic extensions.
RACE_SUFFIX = "us-core-race"
ETHNICITY_SUFFIX = "us-core-ethnicity"


def _typed(resources: DataFrame, resource_type: str, *others: str) -> DataFrame:
    return resources.filter(F.col("resource_type") == resource_type).select(
        "bundle_id", "pos", *others, F.from_json("resource", schemas.RESOURCES[resource_type]).alias("r")
    )


def _at(*keys: str | int) -> Column:
    return get_path(F.col("r"), *keys)


def _ref(field: str) -> Column:
    return normalize_ref(_at(field, "reference"))


def _record(df: DataFrame, record: str, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[columns[f.name].alias(f.name) for f in schemas.RECORDS[record].fields])


def flatten_patients(resources: DataFrame) -> DataFrame:
    given = F.array_join(_at("name", 0, "given"), " ")
    columns = {
        "patient_id": _at("id"),
        "given_name": F.nullif(given, F.lit("")),
        "family_name": _at("name", 0, "family"),
        "gender": _at("gender"),
        "birth_date": _at("birthDate"),
        "deceased_date": _at("deceasedDateTime"),
        "marital_status": _at("maritalStatus", "coding", 0, "code"),
        "race": us_core_display(_at("extension"), RACE_SUFFIX),
        "ethnicity": us_core_display(_at("extension"), ETHNICITY_SUFFIX),
        "city": _at("address", 0, "city"),
        "state": _at("address", 0, "state"),
        "postal_code": _at("address", 0, "postalCode"),
        "country": _at("address", 0, "country"),
    }
    return _record(_typed(resources, "Patient"), "patients", columns)


def flatten_encounters(resources: DataFrame) -> DataFrame:
    columns = {
        "encounter_id": _at("id"),
        "patient_id": _ref("subject"),
        "status": _at("status"),
        "class_code": _at("class", "code"),
        "class_display": _at("class", "display"),
        "type_code": _at("type", 0, "coding", 0, "code"),
        "type_display": _at("type", 0, "coding", 0, "display"),
        "reason_code": _at("reasonCode", 0, "coding", 0, "code"),
        "reason_display": _at("reasonCode", 0, "coding", 0, "display"),
        "start_time": _at("period", "start"),
        "end_time": _at("period", "end"),
        "provider_id": _ref("serviceProvider"),
    }
    return _record(_typed(resources, "Encounter"), "encounters", columns)


def flatten_conditions(resources: DataFrame) -> DataFrame:
    columns = {
        "condition_id": _at("id"),
        "patient_id": _ref("subject"),
        "encounter_id": _ref("encounter"),
        "code_system": _at("code", "coding", 0, "system"),
        "code": _at("code", "coding", 0, "code"),
        "display": _at("code", "coding", 0, "display"),
        "clinical_status": _at("clinicalStatus", "coding", 0, "code"),
        "verification_status": _at("verificationStatus", "coding", 0, "code"),
        "onset_date": _at("onsetDateTime"),
        "abatement_date": _at("abatementDateTime"),
        "recorded_date": _at("recordedDate"),
    }
    return _record(_typed(resources, "Condition"), "conditions", columns)


def medication_lookup(resources: DataFrame) -> DataFrame:
    """(bundle_id, medication_id) -> first coding; the last resource with an id wins."""
    medications = (
        resources.filter(F.col("resource_type") == "Medication")
        .filter(F.get_json_object("resource", "$.id") != "")
        .select(
            "bundle_id", "pos", F.from_json("resource", schemas.RESOURCES["Medication"]).alias("r")
        )
        .select(
            "bundle_id",
            "pos",
            _at("id").alias("medication_id"),
            _at("code", "coding", 0).alias("coding"),
        )
    )
    newest = Window.partitionBy("bundle_id", "medication_id").orderBy(F.desc("pos"))
    return (
        medications.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .select("bundle_id", "medication_id", "coding")
    )


def flatten_medication_requests(resources: DataFrame) -> DataFrame:
    """Inline drug coding, else the medication the request refers to in its own bundle.

    Requests carry that medication in ``linked``. If there is no such column, the two are joined: requests that need
    no lookup must not share one join key (most rows may be such), so their key is their own position; the
    needs-lookup flag keeps that key from matching.
    """
    inline = _at("medicationCodeableConcept", "coding", 0)
    inline_code = inline["code"]
    refers = F.coalesce(_ref("medicationReference") != "", F.lit(False))
    needs = (inline_code.isNull() | (inline_code == "")) & refers
    carried = "linked" in resources.columns
    typed = _typed(resources, "MedicationRequest", *(["linked"] if carried else []))
    requests = typed.select(
        "bundle_id",
        *(["linked"] if carried else []),
        needs.alias("_needs"),
        F.when(needs, _ref("medicationReference")).otherwise(F.col("pos").cast("string")).alias("_key"),
        inline.alias("_inline"),
        _at("id").alias("medication_request_id"),
        _ref("subject").alias("patient_id"),
        _ref("encounter").alias("encounter_id"),
        _at("status").alias("status"),
        _at("intent").alias("intent"),
        _at("authoredOn").alias("authored_on"),
        _at("dosageInstruction", 0, "text").alias("dosage_text"),
    )
    if carried:
        medication = F.from_json(F.when(F.col("_needs"), F.col("linked")), schemas.RESOURCES["Medication"])
        hit = F.col("_needs") & F.col("linked").isNotNull()
        resolved = requests.withColumn("_medication", medication)
        resolved = resolved.withColumn("coding", get_path(F.col("_medication"), "code", "coding", 0))
    else:
        lookup = medication_lookup(resources).select(
            F.col("bundle_id").alias("_bundle"), "medication_id", "coding"
        )
        resolved = requests.join(
            lookup,
            F.col("_needs") & (F.col("bundle_id") == F.col("_bundle")) & (F.col("_key") == F.col("medication_id")),
            "left",
        )
        hit = F.col("medication_id").isNotNull()

    def coded(field: str) -> Column:
        return F.when(hit, F.col("coding")[field]).otherwise(F.col("_inline")[field])

    columns = {f.name: F.col(f.name) for f in schemas.RECORDS["medication_requests"].fields
               if f.name in requests.columns}
    columns |= {
        "code_system": coded("system"),
        "medication_code": coded("code"),
        "medication_display": coded("display"),
    }
    return _record(resolved, "medication_requests", columns)


def flatten_observations(resources: DataFrame) -> DataFrame:
    """One row per component, else one row for the value, else none.

    A value directly on the observation is treated as its only part, so that both forms
    go through the same columns; a component may lack a value, an observation may not.
    """
    own = [_at(v) for v in ("valueQuantity", "valueCodeableConcept", "valueString")]
    has_components = F.size(_at("component")) > 0
    has_value = own[0].isNotNull() | own[1].isNotNull() | own[2].isNotNull()
    whole = F.struct(
        _at("code").alias("code"),
        own[0].alias("valueQuantity"),
        own[1].alias("valueCodeableConcept"),
        own[2].alias("valueString"),
    )
    parts = F.when(has_components, _at("component")).when(has_value, F.array(whole))
    observations = _typed(resources, "Observation").select(
        _at("id").alias("id"),
        has_components.alias("split"),
        _ref("subject").alias("patient_id"),
        _ref("encounter").alias("encounter_id"),
        _at("status").alias("status"),
        _at("category", 0, "coding", 0, "code").alias("category"),
        _at("effectiveDateTime").alias("effective_date"),
        _at("issued").alias("issued_date"),
        F.posexplode(parts).alias("idx", "part"),
    )
    part = F.col("part")
    quantity, concept, text = part["valueQuantity"], part["valueCodeableConcept"], part["valueString"]
    coded = quantity.isNull() & concept.isNotNull()
    label = F.coalesce(F.nullif(concept["text"], F.lit("")), get_path(concept, "coding", 0, "display"))
    columns = {name: F.col(name) for name in observations.columns}
    columns |= {
        "observation_id": F.when(
            F.col("split"), F.concat("id", F.lit("_"), F.col("idx").cast("string"))
        ).otherwise(F.col("id")),
        "parent_observation_id": F.when(F.col("split"), F.col("id")),
        "loinc_code": get_path(part, "code", "coding", 0, "code"),
        "loinc_display": get_path(part, "code", "coding", 0, "display"),
        "value_numeric": quantity["value"].try_cast("double"),
        "value_text": F.when(coded, label).when(quantity.isNull(), text),
        "value_code": F.when(coded, get_path(concept, "coding", 0, "code")),
        "value_code_system": F.when(coded, get_path(concept, "coding", 0, "system")),
        "unit": quantity["unit"],
    }
    return _record(observations, "observations", columns)


# One line per record set: a flattener added here flows through every later stage.
EXTRACTORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "Patient": ("patients", flatten_patients),
    "Encounter": ("encounters", flatten_encounters),
    "Condition": ("conditions", flatten_conditions),
    "MedicationRequest": ("medication_requests", flatten_medication_requests),
    "Observation": ("observations", flatten_observations),
}

# Types to stage for the flatteners: medications are only looked up.
SOURCE_TYPES = (*EXTRACTORS, "Medication")


def unreadable(resources: DataFrame) -> DataFrame:
    """Resources with a field of another type than expected: (bundle_id, pos, resource_type, reason, resource).

    Their flat rows have NULL in such fields; write these next to them, for repair and replay.
    """

    def number(quantity: Column) -> Column:
        return quantity["value"].isNotNull() & quantity["value"].try_cast("double").isNull()

    parts = []
    for kind in SOURCE_TYPES:
        parsed = F.from_json(
            "resource",
            f"{schemas.RESOURCES[kind]}, _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        )
        rows = resources.filter(F.col("resource_type") == kind).withColumn("r", parsed)
        bad_type = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
        reason = F.when(bad_type, F.lit("field of another type"))
        if kind == "Observation":
            lost = number(F.col("r.valueQuantity")) | F.exists("r.component", lambda c: number(c["valueQuantity"]))
            reason = reason.when(lost, F.lit("value is not a number"))
        # Unnesting instead of filtering: a filter would repeat the parsing below it.
        found = F.struct("bundle_id", "pos", "resource_type", reason.alias("reason"), "resource")
        parts.append(rows.select(F.inline(F.when(reason.isNotNull(), F.array(found)))))
    return reduce(DataFrame.unionByName, parts)


def flatten_all(resources: DataFrame) -> dict[str, DataFrame]:
    return {record: flatten(resources) for record, flatten in EXTRACTORS.values()}
