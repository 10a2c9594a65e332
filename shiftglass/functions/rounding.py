"""Guarded ratios and decimal rounding: half away from zero on exact decimals, null for an empty ratio."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXACT = "decimal(38,10)"


def rounded(value: Column, places: int) -> Column:
    """``value`` rounded half up as a decimal, then a double again."""
    return F.round(value.cast(EXACT), places).cast("double")


def ratio(part: Column, whole: Column, places: int | None = None) -> Column:
    """part / whole, null where whole is 0."""
    value = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return value if places is None else rounded(value, places)


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(28,8)"))
