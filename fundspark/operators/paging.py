"""Pages and flagged results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.operators.ranking import POSITION_BITS, placed_rows

MAX_PAGE_SIZE = 100
SHOWN_HITS = 10


def page(
    df: DataFrame, order: Sequence[str | Column], number: int = 0, size: int = 25
) -> DataFrame:
    """One page with ``total``, ``page``, ``page_size`` and ``total_pages`` columns.

    Rows are range-partitioned and sorted by ``order``, which must tell them apart, and staged
    with their places. The rows of each partition are counted: that gives the total, and where
    the page's rows lie, of whose files only the row groups with these places are read. A far
    page costs what the first one does, and no task gets more than its range.
    """
    if number < 0 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 0 and size within 1..{MAX_PAGE_SIZE}")
    placed = placed_rows(df, order)
    # One row per range partition.
    counts = sorted((r._piece, r["count"]) for r in placed.groupBy("_piece").count().collect())
    first, last, before, wanted = number * size, (number + 1) * size, 0, F.lit(False)
    for piece, rows in counts:
        low, high = max(first - before, 0), min(last - before, rows)
        if low < high:
            start = piece << POSITION_BITS
            wanted = wanted | F.col("_pos").between(start + low, start + high - 1)
        before += rows
    return (
        placed.filter(wanted).orderBy("_pos").drop("_pos", "_piece").withColumns(
            {
                "total": F.lit(before).cast("long"),
                "page": F.lit(number),
                "page_size": F.lit(size),
                "total_pages": F.lit(-(-before // size)).cast("long"),
            }
        )
    )


def page_after(df: DataFrame, rank: str, after: int, size: int = 25) -> DataFrame:
    """The page following rank ``after``; its cost does not grow with the page number."""
    return df.filter(F.col(rank) > after).orderBy(rank).limit(size)


def flagged(df: DataFrame, order: Sequence[str | Column], shown: int = SHOWN_HITS) -> DataFrame:
    """All hits with their number (``total``), flagged when it is over ``shown`` ("refine the search")."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.withColumn("total", total).withColumn("refinar_busca", F.col("total") > shown).orderBy(*order)
