"""Numeric columns: guarded ratios, half-even rounding, parsing with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(column: Column) -> Column:
    """NaN and the infinities become NULL."""
    bad = F.isnan(column) | column.isin(float("inf"), float("-inf"))
    return F.when(~bad, column)


def log_ratio(value: Column, previous: Column) -> Column:
    """``ln(value / previous)``; NULL unless the ratio is a positive number."""
    return F.ln(F.try_divide(value.cast("double"), previous.cast("double")))


def percent_change(value: Column, previous: Column) -> Column:
    """Change against a positive previous value in percent, otherwise NULL."""
    value, previous = value.cast("double"), previous.cast("double")
    return F.when(previous > 0, (value - previous) / previous * 100)


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole`` as ``decimal(10,2)``.

    Zero unless ``whole`` is positive; NULL when the result needs more digits.
    Scaling before the division keeps 17 decimal places, so exact halves round up.
    """
    ratio = F.try_divide(part.try_cast("decimal(18,2)") * 100, whole)
    return F.when(whole > 0, ratio).otherwise(F.lit(0)).try_cast("decimal(10,2)")


def round_half_even(column: Column, digits: int) -> Column:
    """Binary rounding to even: scale, round to the nearest integer, scale back."""
    scale = 10.0**digits
    return F.rint(column * scale) / scale


def parse_or(column: Column, kind: str, default: object) -> Column:
    """Typed value of trimmed text; ``default`` for blank, NULL for unreadable."""
    text = F.trim(column)
    return F.when(text == "", F.lit(default).cast(kind)).otherwise(text.try_cast(kind))


def zero_if_empty(column: Column) -> Column:
    """Serving shape: a double, with 0 for NULL."""
    return F.coalesce(column.cast("double"), F.lit(0.0))


def null_if_zero(column: Column) -> Column:
    """Serving shape: a double, with NULL for 0."""
    return F.nullif(column.cast("double"), F.lit(0.0))


def in_millions(column: Column) -> Column:
    return column.cast("double") / 1_000_000
