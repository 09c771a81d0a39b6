"""Keyed operators: dedup, duplicate report, parent check, upsert.

None of them gathers the rows of one key in one task: dedup is an aggregate with
map-side combine, and the joins are equi-joins on unique right-hand keys, whose
skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys equal each other; only the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def dedup_keep(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last"
) -> DataFrame:
    """One row per key: the first or last by ``order``. NULL keys equal each other."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    kept = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*").select(*df.columns)


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every member of every group with more than one row, with the group's size."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    return join_same_keys(df, counts, keys).select(*df.columns, "copies")


def dedup_counters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before dedup, rows after, rows dropped."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    before, after = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return per_key.agg(
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("rows_dropped")
    )


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a key occurs twice or is NULL. Runs one aggregate."""
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    bad = counted.filter(missing | (F.col("copies") > 1)).take(1)
    if bad:
        raise ValueError(f"duplicate or missing key in {list(keys)}: {bad[0].asDict()}")
    return df


def with_parent(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose parent exists (a foreign-key filter)."""
    return df.join(parent.select(*keys), list(keys), "left_semi")


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
) -> DataFrame:
    """The target after upserting ``source``: matched rows take the source's
    ``update_cols`` (NULL included), unmatched source rows are inserted.

    Source keys must be unique. When all columns update, the target only loses the
    matched keys (an anti join against the smaller side, which Spark broadcasts
    when it fits) and is never rewritten column by column; a partial update needs
    the full outer join.
    """
    columns = target.columns
    source = source.select(*columns)
    rest = [c for c in columns if c not in keys]
    updated = rest if update_cols is None else list(update_cols)
    if set(updated) == set(rest):
        return without(target, source, keys).unionByName(source)

    t = target.select("*", F.lit(True).alias("_in_target")).alias("t")
    s = source.select("*", F.lit(True).alias("_in_source")).alias("s")
    joined = t.join(s, list(keys), "full_outer")
    in_source, in_target = F.col("_in_source").isNotNull(), F.col("_in_target").isNotNull()
    picked = list(keys) + [
        F.when(in_source if c in updated else in_source & ~in_target, F.col(f"s.{c}"))
        .otherwise(F.col(f"t.{c}"))
        .alias(c)
        for c in rest
    ]
    return joined.select(*picked).select(*columns)
