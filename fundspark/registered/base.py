"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, NULL kept: the type both engines share."""
    return df.withColumns(
        {name: F.col(name).cast("double") for name, kind in df.dtypes if kind.startswith("decimal")}
    )
