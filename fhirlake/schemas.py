"""Input, parsed and bronze schemas.

Bronze columns are typed; the parsed (interchange) form of the same record keeps
every date as the ISO string found in the source document.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "double": T.DoubleType(),
}


def _struct(spec: str) -> T.StructType:
    fields = []
    for item in spec.split(","):
        name, _, kind = item.strip().partition(":")
        fields.append(T.StructField(name, _TYPES[kind or "string"], True))
    return T.StructType(fields)


# Column names and types of the five record sets, in load order.
RECORDS: dict[str, T.StructType] = {
    "patients": _struct(
        "patient_id, given_name, family_name, gender, birth_date:date, deceased_date:timestamp,"
        "marital_status, race, ethnicity, city, state, postal_code, country"
    ),
    "encounters": _struct(
        "encounter_id, patient_id, status, class_code, class_display, type_code, type_display,"
        "reason_code, reason_display, start_time:timestamp, end_time:timestamp, provider_id"
    ),
    "conditions": _struct(
        "condition_id, patient_id, encounter_id, code_system, code, display, clinical_status,"
        "verification_status, onset_date:timestamp, abatement_date:timestamp, recorded_date:timestamp"
    ),
    "medication_requests": _struct(
        "medication_request_id, patient_id, encounter_id, status, intent, code_system,"
        "medication_code, medication_display, authored_on:timestamp, dosage_text"
    ),
    "observations": _struct(
        "observation_id, parent_observation_id, patient_id, encounter_id, status, category,"
        "loinc_code, loinc_display, value_numeric:double, value_text, value_code,"
        "value_code_system, unit, effective_date:timestamp, issued_date:timestamp"
    ),
}

AUDIT = _struct("load_timestamp:timestamp, load_batch_id")


def parsed_schema(record: str) -> T.StructType:
    """Flat record as the flattener emits it: strings, except numeric measures."""
    return T.StructType(
        [
            f if isinstance(f.dataType, T.DoubleType) else T.StructField(f.name, T.StringType(), True)
            for f in RECORDS[record].fields
        ]
    )


def bronze_schema(record: str) -> T.StructType:
    """Typed record plus the two audit columns."""
    return T.StructType(RECORDS[record].fields + AUDIT.fields)


# Source documents. A resource stays JSON text until it has been routed by type,
# because one field name has different types in different resources.
BUNDLE = "entry array<struct<fullUrl:string,resource:string>>"
BUNDLE_FIELDS = "entry:array<struct<fullUrl:string,resource:string>>"

_CODING = "array<struct<system:string,code:string,display:string>>"
_CODES = "array<struct<code:string>>"
_REF = "struct<reference:string>"
_CONCEPT = f"struct<coding:{_CODING}>"
_VALUES = (
    # read as text, since a number may come quoted; the flattener converts it
    "valueQuantity{s}struct<value:string,unit:string>,"
    f"valueCodeableConcept{{s}}struct<text:string,coding:{_CODING}>,"
    "valueString{s}string"
)

RESOURCES: dict[str, str] = {
    "Patient": (
        "id string, name array<struct<given:array<string>,family:string>>, gender string,"
        "birthDate string, deceasedDateTime string,"
        f"maritalStatus struct<coding:{_CODES}>,"
        "extension array<struct<url:string,"
        "extension:array<struct<url:string,valueCoding:struct<display:string>>>>>,"
        "address array<struct<city:string,state:string,postalCode:string,country:string>>"
    ),
    "Encounter": (
        f"id string, subject {_REF}, status string, class struct<code:string,display:string>,"
        f"type array<{_CONCEPT}>, reasonCode array<{_CONCEPT}>,"
        f"period struct<start:string,end:string>, serviceProvider {_REF}"
    ),
    "Condition": (
        f"id string, subject {_REF}, encounter {_REF}, code {_CONCEPT},"
        f"clinicalStatus struct<coding:{_CODES}>, verificationStatus struct<coding:{_CODES}>,"
        "onsetDateTime string, abatementDateTime string, recordedDate string"
    ),
    "Medication": f"id string, code {_CONCEPT}",
    "MedicationRequest": (
        f"id string, subject {_REF}, encounter {_REF}, status string, intent string,"
        f"medicationCodeableConcept {_CONCEPT}, medicationReference {_REF},"
        "authoredOn string, dosageInstruction array<struct<text:string>>"
    ),
    "Observation": (
        f"id string, subject {_REF}, encounter {_REF}, effectiveDateTime string, issued string,"
        f"status string, category array<struct<coding:{_CODES}>>, code {_CONCEPT},"
        + _VALUES.format(s=" ")
        + f", component array<struct<code:{_CONCEPT},"
        + _VALUES.format(s=":")
        + ">>"
    ),
}
