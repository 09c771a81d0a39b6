"""Landing archives as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundspark.sources.archives import land_members, read_archives


def unzip_landing(
    spark: SparkSession, path: str, out: str | None = None, suffix: str = ".csv"
) -> DataFrame:
    """Lines of the archives' members.

    With ``out`` they are written there for the loaders: each member is a folder
    ``out/archive/path/name.csv`` with one file, byte for byte. A member is written by the task
    that unpacks it.
    """
    if out is None:
        return read_archives(spark, path, suffix)
    land_members(spark, path, out, suffix)
    return read_archives(spark, path, suffix, full_path=True)
