"""Identifier, label and tag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themelens.constants import MANAGED_KEY_PREFIX

_DIGITS = r"^[0-9]+$"
_NUMBER_LIKE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"


def strip(value: Column) -> Column:
    """Remove surrounding whitespace of any kind."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def normalize_opaque_id(value: Column) -> Column:
    """Trimmed identifier; digits lose leading zeros, other number-like text and zero are NULL."""
    cleaned = strip(value.cast("string"))
    digits = F.regexp_replace(cleaned, r"^0+(?=[0-9])", "")
    return (
        F.when(cleaned == "", None)
        .when(cleaned.rlike(_DIGITS), F.when(digits != "0", digits))
        .when(cleaned.rlike(_NUMBER_LIKE), None)
        .otherwise(cleaned)
    )


def normalize_genre(value: Column) -> Column:
    return F.lower(strip(value))


def parse_tag_date(value: Column) -> Column:
    """YYYY/MM/DD or YYYY-MM-DD, anything else NULL."""
    return F.coalesce(
        F.to_date(F.try_to_timestamp(value, F.lit("yyyy/M/d"))),
        F.to_date(F.try_to_timestamp(value, F.lit("yyyy-M-d"))),
    )


def blank_to_null(value: Column) -> Column:
    cleaned = strip(value)
    return F.when(cleaned != "", cleaned)


def managed_key(prefix: str = MANAGED_KEY_PREFIX) -> Column:
    """Versioned key of one score row: month plus a digest of its identity."""
    identity = F.concat_ws(
        "\x1f",
        "scope_name",
        "cadence",
        F.date_format("period_start", "yyyy-MM-dd"),
        F.date_format("period_end", "yyyy-MM-dd"),
        "game_theme",
    )
    return F.concat(
        F.lit(f"{prefix}:"), F.date_format("period_start", "yyyy-MM"), F.lit(":"), F.sha2(identity, 256)
    )


def is_managed_key(value: Column, prefix: str = MANAGED_KEY_PREFIX) -> Column:
    return value.rlike(f"^{prefix}:[0-9]{{4}}-[0-9]{{2}}:[0-9a-f]{{64}}$")
