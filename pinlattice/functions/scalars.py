"""Dates and strict conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000
# Day number of 1970-01-01 in the proleptic calendar that starts at 0001-01-01.
_EPOCH_ORDINAL = 719163


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days of a difference, rounded down (also below zero)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY))


def release_distance(a: Column, b: Column) -> Column:
    return F.abs(floor_days(a, b))


def release_ordinal(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")) + F.lit(_EPOCH_ORDINAL)


def release_age(ts: Column, cutoff: Column) -> Column:
    return F.when(ts.isNotNull(), F.greatest(floor_days(cutoff, ts), F.lit(0)).cast("double"))


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def to_bool(text: Column) -> Column:
    """struct(value, violation): strict true/false text."""
    lower = F.lower(F.trim(text.cast("string")))
    return F.struct(
        F.when(lower == "true", True).when(lower == "false", False).alias("value"),
        F.when(~F.coalesce(lower.isin("true", "false"), F.lit(False)), "not a boolean").alias(
            "violation"
        ),
    )


def to_number(value: Column, fallback: Column | float) -> Column:
    """Boolean text becomes 1/0, other text a double, anything else the fallback."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    parsed = (
        F.when(text == "true", 1.0)
        .when(text == "false", 0.0)
        .when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    )
    return F.coalesce(parsed, F.lit(fallback) if isinstance(fallback, float) else fallback)
