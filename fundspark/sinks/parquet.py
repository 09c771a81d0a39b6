"""Parquet tables: refresh, append, monthly partitions, keyed upsert."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.dates import month_key
from fundspark.operators.filters import MONTH
from fundspark.operators.keys import merge_upsert, require_keys
from fundspark.session import remove, scratch_path
from fundspark.sources.tables import OLD, file_system, path_has_data

#: The folder of a partition whose value is NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def balanced(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Size the output files: small partitions are merged, a hot one is split."""
    return df.hint("rebalance", *partition_by)


def dealt(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` as a table partitioned by these text columns wants it: balanced, and in each task sorted
    by them. Columns added behind it are then written without being shuffled or sorted.

    NULL takes the name of its folder, with which a column that is never NULL keeps its order
    while it is written; the table has the same folders.
    """
    named = {c: F.coalesce(F.col(c), F.lit(NO_VALUE)) for c in partition_by}
    return balanced(df.withColumns(named), partition_by).sortWithinPartitions(*partition_by)


def refresh(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), balance: bool = True
) -> None:
    """Replace the whole table; ``balance=False`` when ``df`` is already laid out like it.

    The new version is written beside the table and takes its place by two renames only
    when it is complete, so ``df`` may read the table itself, and a failed write leaves the
    old rows. Should a run end between the renames, the next access puts the old version back.
    """
    spark = df.sparkSession
    there = path_has_data(spark, path)
    base = path.rstrip("/")
    new, old = f"{base}._new-{uuid.uuid4().hex}", base + OLD
    rows = balanced(df, partition_by) if balance else df
    try:
        rows.write.partitionBy(*partition_by).parquet(new)
    except BaseException:
        remove(spark, new)
        raise
    fs, at = file_system(spark, base)
    if there and not fs.rename(at(base), at(old)):
        raise OSError(f"cannot set {base} aside")
    if not fs.rename(at(new), at(base)):
        raise OSError(f"cannot put {new} in place of {base}")
    remove(spark, old)


def refresh_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], balance: bool = True
) -> None:
    """Replace only the partitions that occur in ``df``."""
    rows = balanced(df, partition_by) if balance else df
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def with_month(df: DataFrame, date: str = "dt_comptc") -> DataFrame:
    return df.withColumn(MONTH, month_key(F.col(date)))


def stamped(df: DataFrame) -> DataFrame:
    """Attach the creation time of a derived table."""
    return df.withColumn("dt_criacao", F.current_timestamp())


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    month_of: str | None = None,
) -> None:
    """Upsert ``source`` into the Parquet table at ``path``; creates it when absent.

    With ``month_of`` (a key column) the table is partitioned by month, and only
    the months that occur in the source are read and rewritten. Running the same
    upsert again changes nothing, so a failed run can simply be repeated.
    """
    # The source is used three times below; stage it rather than recompute it.
    stage = scratch_path(spark, "upsert")
    source.write.parquet(stage)
    try:
        _upsert_staged(spark, path, spark.read.schema(source.schema).parquet(stage), keys, update_cols, month_of)
    finally:
        remove(spark, stage)


def _upsert_staged(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None,
    month_of: str | None,
) -> None:
    require_keys(source, keys)
    there = path_has_data(spark, path)
    if month_of is None:
        if there:
            source = merge_upsert(spark.read.parquet(path), source, keys, update_cols)
        refresh(source, path)
        return
    source = with_month(source, month_of)
    if not there:
        refresh_partitions(source, path, [MONTH])
        return
    months = [r[0] for r in source.select(MONTH).distinct().collect()]
    target = spark.read.schema(source.schema).parquet(path).filter(F.col(MONTH).isin(months))
    refresh_partitions(merge_upsert(target, source, [*keys, MONTH], update_cols), path, [MONTH])
