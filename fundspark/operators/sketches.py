"""Approximate distinct counts from sketches that are kept per day and merged for any range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.operators.filters import date_range

#: Registers as a power of two, and the relative error of three standard deviations.
PRECISION = 14
RELATIVE_ERROR = 3 * 1.04 / 2 ** (PRECISION / 2)
SEPARATOR = "\u0001"


def daily_sketches(df: DataFrame, keys: Sequence[str], date: str = "dt_comptc", precision: int = PRECISION) -> DataFrame:
    """One row per date: its number of rows and a HyperLogLog sketch of its distinct keys (NULL keys left out).

    A sketch has a bounded size, so that a table of them is small whatever it counts.
    """
    key = F.when(F.forall(F.array(*keys), lambda x: x.isNotNull()), F.concat_ws(SEPARATOR, *keys))
    return df.groupBy(date).agg(F.count("*").alias("linhas"), F.hll_sketch_agg(key, precision).alias("esboco"))


def distinct_from_sketches(sketches: DataFrame, start=None, end=None, date: str = "dt_comptc") -> DataFrame:
    """One row: rows and estimated distinct keys (``distintos``) of a date range, from the days' sketches."""
    return date_range(sketches, start, end, date).agg(
        F.coalesce(F.sum("linhas"), F.lit(0)).alias("linhas"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("esboco")), F.lit(0)).alias("distintos"),
    )
