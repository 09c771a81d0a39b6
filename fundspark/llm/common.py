"""Helpers that the corpus operators share: staged tables and global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundspark.session import staged as stage

__all__ = ["POSITION", "documents", "positioned", "stage"]

POSITION = "_position"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def positioned(df: DataFrame, *order: Column) -> DataFrame:
    """Staged ``df`` with its global position (``_position``, from 0) in ``order``.

    Rows are range-partitioned and sorted; a row's position is its place in its
    partition plus the rows of earlier partitions. Only one count per partition is
    broadcast. Rows that tie in ``order`` may swap, so end it with a unique column.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}),
        "positioned",
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition: the only window here without a key.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + place).alias(POSITION)
    )
