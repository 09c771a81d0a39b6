"""Row filters. Latest-date filters use scalar subqueries, which Spark pushes into the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.functions.dates import month_key
from fundspark.functions.text import contains_ignoring_case, strip_tax_id

DATE = "dt_comptc"
# The partition column of stored tables: the month of ``dt_comptc`` as yyyyMM.
MONTH = "ym"
# Days behind the latest date for each named period.
PERIOD_DAYS = {"dia": 0, "7_dias": 7, "31_dias": 31}
MIN_TERM = 3

Day = dt.date | str


def _day(value: Day) -> Column:
    return F.lit(value).cast("date")


def _from(df: DataFrame, day: Column, column: str) -> DataFrame:
    """Rows on or after ``day``; on a table partitioned by month, of those months only."""
    df = df.filter(F.col(column) >= day)
    return df.filter(_month() >= _month_of(day)) if _has_months(df, column) else df


def _until(df: DataFrame, day: Column, column: str) -> DataFrame:
    df = df.filter(F.col(column) <= day)
    return df.filter(_month() <= _month_of(day)) if _has_months(df, column) else df


def _on(df: DataFrame, day: Column, column: str) -> DataFrame:
    df = df.filter(F.col(column) == day)
    return df.filter(_month() == _month_of(day)) if _has_months(df, column) else df


def _has_months(df: DataFrame, column: str) -> bool:
    return column == DATE and MONTH in df.columns


def _month() -> Column:
    return F.col(MONTH).cast("int")


def _month_of(day: Column) -> Column:
    return month_key(day).cast("int")


def latest_date(df: DataFrame, column: str = DATE) -> Column:
    """The frame's greatest date as a scalar subquery; looks at the newest month only
    when the table is partitioned by month."""
    if _has_months(df, column):
        df = df.filter(_month() == df.agg(F.max(_month()).alias(MONTH)).scalar())
    return df.agg(F.max(column).alias(column)).scalar()


def date_range(
    df: DataFrame, start: Day | None = None, end: Day | None = None, column: str = DATE
) -> DataFrame:
    """Inclusive date range; either bound may be absent."""
    if start is not None:
        df = _from(df, _day(start), column)
    if end is not None:
        df = _until(df, _day(end), column)
    return df


def date_range_or_latest(
    df: DataFrame,
    start: Day | None = None,
    end: Day | None = None,
    among: DataFrame | None = None,
    column: str = DATE,
) -> DataFrame:
    """``date_range``, or the latest date (of ``among``) when no bound is given."""
    if start is None and end is None:
        return _on(df, latest_date(df if among is None else among, column), column)
    return date_range(df, start, end, column)


def trailing_period(df: DataFrame, period: str = "dia", column: str = DATE) -> DataFrame:
    """Named period up to the latest date; an unknown name means the latest day.

    Seven days back from the latest date keep eight dates.
    """
    return last_days(df, PERIOD_DAYS.get(period, 0), column)


def last_days(df: DataFrame, days: int, column: str = DATE) -> DataFrame:
    latest = latest_date(df, column)
    return _from(df, F.date_sub(latest, days), column) if days else _on(df, latest, column)


def one_of(df: DataFrame, column: str, values: Sequence[str] | DataFrame | None) -> DataFrame:
    """IN-list filter; an empty list keeps everything.

    A long list is given as a one-column frame and becomes a semi join.
    """
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.filter(F.col(column).isin(list(values))) if values else df


def vehicle(df: DataFrame, cnpj: str, tp: str) -> DataFrame:
    return df.filter((F.col("cnpj_fundo_classe") == cnpj) & (F.col("tp_fundo_classe") == tp))


def class_funds(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tp_fundo_classe").contains("CLASSES"))


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) > 0))


def any_flow(df: DataFrame) -> DataFrame:
    return df.filter(F.col("resg_dia").isNotNull() | F.col("captc_dia").isNotNull())


def named_manager(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("cpf_cnpj_gestor").isNotNull() & F.col("gestor").isNotNull() & (F.col("gestor") != "")
    )


def not_cancelled(df: DataFrame) -> DataFrame:
    """Rows with an unknown status are dropped as well."""
    return df.filter(F.col("situacao") != "Cancelado")


def name_contains(df: DataFrame, column: str, term: str | None, minimum: int = 0) -> DataFrame:
    """Case-insensitive substring filter; shorter terms than ``minimum`` filter nothing."""
    if not term or len(term) < minimum:
        return df
    return df.filter(contains_ignoring_case(F.col(column), term))


def tax_id_or_name(term: str, tax_id: Column, name: Column) -> tuple[Column, Column]:
    """Match conditions of a lookup term: tax-id prefix, name substring."""
    digits = strip_tax_id(F.lit(term))
    is_id = (digits != "") & F.startswith(strip_tax_id(tax_id), digits)
    return is_id, contains_ignoring_case(name, term)


def grid_filter(
    df: DataFrame,
    allowed: Sequence[str],
    filters: dict[str, str] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Grid filters: per-column substrings (all must match) and one search over all."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    for name, term in (filters or {}).items():
        if name not in allowed:
            raise ValueError(f"column cannot be filtered: {name}")
        df = df.filter(contains_ignoring_case(text(name), term))
    if search:
        hit = F.lit(False)
        for name in allowed:
            hit = hit | contains_ignoring_case(text(name), search)
        df = df.filter(hit)
    return df


def grid_sort(allowed: Sequence[str], sort: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort columns of a grid request, each ``(name, descending)``."""
    columns = []
    for name, descending in sort:
        if name not in allowed:
            raise ValueError(f"column cannot be sorted: {name}")
        columns.append(F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last())
    return columns
