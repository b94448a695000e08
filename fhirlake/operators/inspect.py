"""Diagnostics on staged resources and on flattened observations.

Resources come as JSON text (``resource``) or parsed once (``doc``, see `as_variants`); results are the same.
With text every path reads the whole text again, with variants a path leads to its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fhirlake.sources.shared import through_table

# Value fields of an observation in the order they are looked for.
VALUE_SHAPES = [
    "valueQuantity",
    "valueCodeableConcept",
    "valueString",
    "valueBoolean",
    "component",
    "valueInteger",
]
OTHER_SHAPE = "OTHER"
KNOWN_SHAPES = ["valueQuantity", "valueCodeableConcept", "valueString", "component"]


def as_variants(resources: DataFrame) -> DataFrame:
    """The resources with ``doc``, each text parsed to a VARIANT once and written, instead of ``resource``."""
    parsed = resources.withColumn("doc", F.try_parse_json("resource")).drop("resource")
    return through_table(parsed, "variants")


def _parsed(resources: DataFrame) -> bool:
    return "doc" in resources.columns


def _text(resources: DataFrame, path: str) -> Column:
    return F.try_variant_get("doc", path, "string") if _parsed(resources) else F.get_json_object("resource", path)


def _items(resources: DataFrame, path: str) -> Column:
    """Number of items of an array; NULL without one."""
    if _parsed(resources):
        return F.size(F.try_variant_get("doc", path, "array<variant>"))
    return F.json_array_length(F.get_json_object("resource", path))


def _has_key(resources: DataFrame, key: str) -> Column:
    """Key is present, even with a JSON null."""
    if _parsed(resources):
        return F.try_variant_get("doc", f"$.{key}", "variant").isNotNull()
    keys = F.col("keys") if "keys" in resources.columns else F.json_object_keys("resource")
    return F.array_contains(keys, key)


def _observations(resources: DataFrame) -> DataFrame:
    found = resources.filter(F.col("resource_type") == "Observation")
    if _parsed(resources):
        return found.select("bundle_id", "pos", "doc")
    return found.select("bundle_id", "pos", "resource", F.json_object_keys("resource").alias("keys"))


def observation_shapes(resources: DataFrame) -> DataFrame:
    """Observations per value shape."""
    found = _observations(resources)
    shape = F.coalesce(*[F.when(_has_key(found, s), s) for s in VALUE_SHAPES], F.lit(OTHER_SHAPE))
    return found.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def unvalued_observations(resources: DataFrame) -> DataFrame:
    """Observations with none of the known value fields and no components."""
    found = _observations(resources)
    for shape in KNOWN_SHAPES:
        found = found.filter(~_has_key(found, shape))
    return found


def unvalued_codes(resources: DataFrame) -> DataFrame:
    found = unvalued_observations(resources)
    first = found.select(
        _text(found, "$.code.coding[0].code").alias("loinc_code"),
        _text(found, "$.code.coding[0].display").alias("loinc_display"),
    )
    return first.groupBy("loinc_code", "loinc_display").agg(F.count(F.lit(1)).alias("n"))


def unvalued_fields(resources: DataFrame) -> DataFrame:
    found = unvalued_observations(resources)
    keys = F.json_object_keys(F.to_json("doc")) if _parsed(found) else F.col("keys")  # these are few
    return (
        found.select(F.explode(keys).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def empty_observation_rows(observations: DataFrame) -> DataFrame:
    """Flat rows that carry no value of any kind."""
    return observations.filter("value_numeric IS NULL AND value_text IS NULL AND value_code IS NULL")


def empty_observation_counts(observations: DataFrame) -> DataFrame:
    """How many there are, split by whether they come from a component."""
    return empty_observation_rows(observations).agg(
        F.count(F.lit(1)).alias("empty_rows"),
        F.count_if(F.col("parent_observation_id").isNotNull()).alias("from_components"),
        F.count_if(F.col("parent_observation_id").isNull()).alias("not_from_components"),
    )


def find_resource(
    resources: DataFrame,
    resource_type: str,
    resource_id: str | None = None,
    full_url: str | None = None,
    bundle_contains: str | None = None,
) -> DataFrame:
    """Resources by id or full url, optionally within the bundles whose name has a text."""
    found = resources.filter(F.col("resource_type") == resource_type)
    if bundle_contains is not None:
        found = found.filter(F.col("bundle_id").contains(bundle_contains))
    if full_url is not None:
        found = found.filter(F.col("full_url") == full_url)
    if resource_id is not None:
        found = found.filter(_text(found, "$.id") == resource_id)
    return found


def medication_forms(resources: DataFrame) -> DataFrame:
    """Which form of drug reference each medication request uses."""
    requests = resources.filter(F.col("resource_type") == "MedicationRequest")
    contained = _items(requests, "$.contained")
    return requests.select(
        "bundle_id",
        _text(requests, "$.id").alias("medication_request_id"),
        _has_key(requests, "medicationCodeableConcept").alias("has_inline"),
        _has_key(requests, "medicationReference").alias("has_reference"),
        _has_key(requests, "medication").alias("has_medication"),
        F.coalesce(contained, F.lit(0)).cast("long").alias("contained_resources"),
    )


def component_counts(resources: DataFrame) -> DataFrame:
    """Number of components of each observation, with its code text."""
    observations = resources.filter(F.col("resource_type") == "Observation")
    components = _items(observations, "$.component")
    return observations.select(
        "bundle_id",
        _text(observations, "$.id").alias("observation_id"),
        _text(observations, "$.code.text").alias("code_text"),
        F.coalesce(components, F.lit(0)).cast("long").alias("components"),
    )
