"""Named views over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundspark.schemas import BLOCKS, ORIGINS, block_schema, block_table
from fundspark.sources.tables import positions_table


def as_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def example_model(spark: SparkSession) -> DataFrame:
    """The constant model, as a view."""
    df = spark.sql("SELECT 1 AS id, 'teste' AS nome")
    as_view(df, "example_model")
    return df


def block_views(spark: SparkSession, path: str) -> list[str]:
    """One typed view per portfolio block over the single partitioned table."""
    names = []
    for block in BLOCKS:
        columns = block_schema(block).fieldNames()
        as_view(positions_table(spark, path, ORIGINS[block]).select(*columns), block_table(block))
        names.append(block_table(block))
    return names
