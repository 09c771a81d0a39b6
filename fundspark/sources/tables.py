"""Stored tables: predicate reads, existence lookups, the portfolio block view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession,
    source: str,
    columns: Sequence[str] | None = None,
    predicate: Column | str | None = None,
) -> DataFrame:
    """A Parquet path or catalog table; columns and predicate reach the scan."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def tables_like(spark: SparkSession, prefix: str) -> list[str]:
    """Catalog names starting with ``prefix``."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose MIN, MAX and COUNT come from the files' footers, where no row filter stands
    before them; grouping by partition columns is allowed.

    Read by a session of its own, in which the newer file reader and its aggregate pushdown are on;
    other frames keep their reader.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path)


def stored_latest_date(spark: SparkSession, path: str, column: str = "dt_comptc") -> DataFrame:
    """One row, ``ultima_data``: the greatest date of a stored table, without reading its rows.

    Of a table partitioned by month (``ym``) only the newest month's footers are read.
    """
    table = from_footers(spark, path)
    if "ym" in table.columns:
        # The months are in the folders' names.
        folders = {part.split("=")[1] for f in table.inputFiles() for part in f.split("/") if part.startswith("ym=")}
        table = table.filter(F.col("ym").cast("string") == max(folders, default=""))
    return table.agg(F.max(column).alias("ultima_data"))


def stored_month_ranges(spark: SparkSession, path: str, column: str = "dt_comptc") -> DataFrame:
    """First and last date and rows of each month of a table partitioned by ``ym``, from the footers."""
    return from_footers(spark, path).groupBy("ym").agg(
        F.min(column).alias("primeira_data"), F.max(column).alias("ultima_data"), F.count(column).alias("linhas")
    )


#: Ends the name under which a table waits while its new version takes its place.
OLD = "._old"


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and what turns names into its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def path_has_data(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table was already written to ``path``; only that is asked, and other
    errors come through. A version that a broken replacement set aside is put back first."""
    base = path.rstrip("/")
    fs, at = file_system(spark, base)
    if fs.exists(at(base)):
        return True
    return bool(fs.exists(at(base + OLD)) and fs.rename(at(base + OLD), at(base)))


def positions_table(spark: SparkSession, path: str, origin: str | None = None) -> DataFrame:
    """The portfolio table; ``origin`` prunes to one block's partitions."""
    df = spark.read.parquet(path)
    return df if origin is None else df.filter(F.col("origem_tabela") == origin)
