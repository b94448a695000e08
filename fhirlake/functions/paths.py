"""Null-safe access to nested documents and reference clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference and extension markers of the source format.
URN_PREFIX = "urn:uuid:"
CONDITIONAL_REF = "?identifier="
OMB_CATEGORY = "ombCategory"


def get_path(col: Column, *keys: str | int) -> Column:
    """Walk struct fields (str) and array positions (int); NULL where a step is missing."""
    for key in keys:
        col = F.get(col, F.lit(key)) if isinstance(key, int) else col.getField(key)
    return col


def normalize_ref(ref: Column) -> Column:
    """Bare id of a reference: urn form, conditional form, ``Type/id``, or already bare."""
    conditional = F.when(ref.contains("|"), F.substring_index(ref, "|", -1)).otherwise(
        F.substring_index(ref, "=", -1)
    )
    return (
        F.when(ref == "", F.lit(None).cast("string"))
        .when(ref.startswith(URN_PREFIX), F.substr(ref, F.lit(len(URN_PREFIX) + 1)))
        .when(ref.contains(CONDITIONAL_REF), conditional)
        .when(ref.contains("/"), F.substr(ref, F.instr(ref, "/") + 1))
        .otherwise(ref)
    )


def us_core_display(extensions: Column, url_suffix: str) -> Column:
    """Display of the first category entry under the extensions whose url has the suffix."""
    matching = F.filter(extensions, lambda e: e["url"].endswith(url_suffix))
    categories = F.transform(
        matching, lambda e: F.filter(e["extension"], lambda s: s["url"] == OMB_CATEGORY)
    )
    present = F.flatten(F.filter(categories, lambda c: c.isNotNull()))
    return get_path(present, 0, "valueCoding", "display")
