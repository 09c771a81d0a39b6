"""Text columns: tax ids, width limits, case-insensitive search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAX_ID_LENGTH = 14
TAX_ID_PUNCTUATION = "./-"


def blank_to_null(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def strip_tax_id(column: Column) -> Column:
    """Drop the punctuation of a tax id; NULL stays NULL."""
    return F.translate(column, TAX_ID_PUNCTUATION, "")


def pad_tax_id(column: Column) -> Column:
    """Strip a company tax id and restore lost leading zeros; never shortens."""
    plain = blank_to_null(strip_tax_id(column))
    return F.when(
        F.length(plain) < TAX_ID_LENGTH, F.lpad(plain, TAX_ID_LENGTH, "0")
    ).otherwise(plain)


def format_tax_id(column: Column) -> Column:
    """``00.000.000/0000-00`` from fourteen digits."""
    return F.regexp_replace(
        column, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"
    )


def truncate(column: Column, length: int) -> Column:
    return F.substring(column, 1, length)


def fixed_chars(column: Column, length: int) -> Column:
    """Trim, turn blank into NULL and cut to ``length`` characters."""
    return truncate(blank_to_null(column), length)


def contains_ignoring_case(column: Column, term: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def join_text(*columns: Column) -> Column:
    """Concatenate and skip NULLs, the way a SQL database's ``CONCAT`` does."""
    return F.concat_ws("", *columns)
