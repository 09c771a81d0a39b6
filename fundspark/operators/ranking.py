"""Ranks and lags that no single task has to finish alone.

There is one plan for every size. Rows are range-partitioned on the full sort key and staged
once as Parquet, so that a global rank is "rows in earlier partitions + row position", and a
group is ranked or lagged piece by piece with the pieces stitched together. Building such a
frame runs a fixed number of jobs. A rank that follows a lag takes over its row numbers.

Where groups are known to be small (``has_large_group``), one window each does the same with one
shuffle each (``lag_of_small_groups``, ``rank_of_small_groups``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from fundspark.operators.keys import join_same_keys
from fundspark.session import shuffles_dropped, staged

# monotonically_increasing_id keeps the row position in its lower 33 bits.
POSITION_BITS = 33
#: Rows of a group that one task may sort; larger groups are lagged and ranked piece by piece.
GROUP_ROWS = 1 << 20
#: Groups are counted by so many bins of their hash.
GROUP_BINS = 1 << 16


def placed_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort by ``order``; stage with each row's ``_pos`` and ``_piece``.

    Staged, because the range bounds are sampled and a recomputed partition must
    not move rows.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ordered.withColumn("_pos", F.monotonically_increasing_id()), "placed")
    return placed.withColumn("_piece", F.shiftright("_pos", POSITION_BITS))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number (``_copy``) that a repeated task gives again.

    A partition's rows are sorted by all columns before they are counted, so that the number
    follows from what is in the partition and not from the order in which it came.
    """
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # Sorted by their hash first: a number is compared faster than texts with long common beginnings.
    ordered = df.sortWithinPartitions(F.xxhash64(*sortable), *sortable)
    return ordered.withColumn("_copy", F.monotonically_increasing_id())


def _together(keys: Sequence[str]) -> list[Column]:
    """A sort order that keeps groups together, whatever their turn."""
    return [F.xxhash64(*keys), *map(F.col, keys)]


def _placed_groups(
    df: DataFrame, groups: Sequence[str | Column], order: Sequence[Column], number: str | None = None
) -> DataFrame:
    """All rows placed by group and order.

    Copies of one row have equal sort values; a row number lets them spread over several
    pieces. It is the column ``number``, which tells rows apart, or made here.
    """
    numbered = df if number else _numbered(df)
    return placed_rows(numbered, [*groups, *order, number or "_copy"])


def in_place_order(df: DataFrame) -> DataFrame:
    """Placed rows in the order of their places: the pieces in turn, each sorted.

    Rows go to the partition that their piece names; nothing is sampled.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(pieces, F.col("_piece").cast("int")).sortWithinPartitions("_pos")


def sorted_by(df: DataFrame, *order: Column) -> DataFrame:
    """Sort by ``order``, then by all columns: rows with equal sort values (one date,
    unknown values) then need not fall into one sort partition."""
    return df.orderBy(*order, *df.columns)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "ranking") -> DataFrame:
    """Number all rows 1..n by ``order``, which must identify a row.

    Only one count per range partition is broadcast, whatever the size of the data. The
    result is not sorted.
    """
    placed = placed_rows(df, order)
    counts = placed.groupBy("_piece").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_pos").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_piece").select(
        *df.columns, (F.col("_before") + position + 1).alias(name)
    )


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    number: str | None = None,
    groups: Sequence[Column] | None = None,
) -> DataFrame:
    """``row_number`` per group.

    ``number`` names a column that tells rows apart and does not change when they are read again,
    as :func:`lag_in_group` can leave one; without it rows are numbered here. With ``groups``, the
    sort order of the keys, the result is sorted by these and the rank.
    """
    placed = _placed_groups(df, groups or _together(keys), order, number)
    # Rows of a piece are sorted by key, so those of a group follow each other in it.
    pieces = placed.groupBy(*keys, "_piece").agg(
        F.count("*").alias("_rows"), F.min("_pos").alias("_first")
    )
    before = F.sum("_rows").over(
        W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        *keys, "_piece", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset")
    )
    ranked = join_same_keys(placed, offsets, [*keys, "_piece"])
    return (in_place_order(ranked) if groups else ranked).select(
        *df.columns, (F.col("_pos") + F.col("_offset")).alias(name)
    )


def lag_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    lags: Mapping[str, str],
    number: str | None = None,
) -> DataFrame:
    """Previous-row values per group; ``lags`` maps new column to source column.

    ``number`` names a further column of the result: the row's place, which tells rows apart
    and stays what it is, for :func:`rank_in_group`.
    """
    placed = _placed_groups(df, _together(keys), order)
    within = W.partitionBy(*keys, "_piece").orderBy("_pos")
    local = placed.withColumns(
        {
            "_row": F.row_number().over(within),
            **{f"_lag_{new}": F.lag(src).over(within) for new, src in lags.items()},
        }
    )
    # The last row of each piece is what the next piece's first row looks back to.
    tails = placed.groupBy(*keys, "_piece").agg(
        F.max_by(F.struct(*[F.col(src).alias(new) for new, src in lags.items()]), "_pos").alias("_tail")
    )
    carried = tails.select(
        *keys, "_piece", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_piece")).alias("_carry")
    )
    return join_same_keys(local, carried, [*keys, "_piece"]).select(
        *df.columns,
        *[
            F.when(F.col("_row") == 1, F.col(f"_carry.{new}")).otherwise(F.col(f"_lag_{new}")).alias(new)
            for new in lags
        ],
        *([F.col("_pos").alias(number)] if number else []),
    )


def has_large_group(df: DataFrame, *groupings: Sequence[str]) -> bool:
    """Whether a group by any of the groupings may have more than ``GROUP_ROWS`` rows.

    One pass over the key columns; only counts of hash bins are shuffled. A bin holds several
    groups, so that small ones may count as large, but never a large one as small.
    """
    bins = [
        F.struct(F.lit(i).alias("of"), F.pmod(F.xxhash64(*keys), F.lit(GROUP_BINS)).alias("bin"))
        for i, keys in enumerate(groupings)
    ]
    counts = df.select(F.explode(F.array(*bins)).alias("_bin")).groupBy("_bin").count()
    with shuffles_dropped(df.sparkSession):
        return not counts.filter(F.col("count") > GROUP_ROWS).isEmpty()


def lag_of_small_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    lags: Mapping[str, str],
    number: str,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`lag_in_group` for groups that a task can sort; ``number`` is the row's place in its group.

    Rows with the same ``together``, some of the keys, come out next to each other. A task must be able
    to sort them, too; what they share takes little room in a shuffle that follows.
    """
    low = F.lit((1 << 32) - 1)
    together = together or keys
    # Sorted by their hash first: a number is compared faster than texts with long common beginnings.
    hashed = F.xxhash64(*together).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(*keys).bitwiseAND(low))
    within = W.partitionBy("_hash", *keys).orderBy(*order)
    return df.repartition(*together).withColumn("_hash", hashed).select(
        *df.columns,
        *[F.lag(src).over(within).alias(new) for new, src in lags.items()],
        F.row_number().over(within).cast("bigint").alias(number),
    )


def rank_of_small_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number`` of groups that a task can sort; the result is sorted by keys and rank.

    The range partitions that sort it hold whole groups, so that nothing else is shuffled."""
    within = W.partitionBy(*keys).orderBy(*order)
    return df.repartitionByRange(*keys).withColumn(name, F.row_number().over(within).cast("bigint"))
