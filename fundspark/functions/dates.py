"""Date columns: permissive and fixed-format parsing, month tokens, day buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stand-in for an unreadable date, and the nanosecond clock's range.
INVALID_DATE = "1900-01-01"
DATE_FORMS = ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))
NANOSECOND_RANGE = ("1677-09-22", "2262-04-11")


def fix_invalid_date(column: Column, nanosecond_range: bool = False) -> Column:
    """Dates of a known form stay, blanks become NULL, anything else becomes 1900-01-01.

    Known are ISO dates, also with a time, ``DATE_FORMS``, and nothing else.

    ``nanosecond_range`` also treats dates a 64-bit nanosecond clock cannot hold
    as unreadable.
    """
    text = F.trim(column)
    forms = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date")) for shape, form in DATE_FORMS]
    parsed = F.coalesce(*forms, text.try_cast("date"))
    readable = parsed.isNotNull()
    if nanosecond_range:
        low, high = (F.lit(d).cast("date") for d in NANOSECOND_RANGE)
        readable = readable & parsed.between(low, high)
    return F.when(
        F.trim(column) != "",
        F.when(readable, parsed).otherwise(F.lit(INVALID_DATE).cast("date")),
    )


def compact_date(column: Column) -> Column:
    """``yyyyMMdd`` text to a date; NULL when it does not parse."""
    return F.try_to_date(column, "yyyyMMdd")


def month_token(file_name: Column) -> Column:
    """The first month of a ``..._YYYYMM...`` file name, NULL without one."""
    digits = F.regexp_extract(file_name, r"_(\d{6})\d*\.[^.]*$", 1)
    return F.try_to_date(F.concat(digits, F.lit("01")), "yyyyMMdd")


def month_key(column: Column) -> Column:
    """``yyyyMM``, the partition value of monthly tables."""
    return F.date_format(column, "yyyyMM")


def day_bucket(column: Column) -> Column:
    return F.date_format(column, "yyyy.MM.dd")
