"""Incremental daily load: newly landed files are cleaned and upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundspark import schemas
from fundspark.plans.loaders import clean_daily
from fundspark.sinks.counters import Counters
from fundspark.sinks.parquet import upsert_table
from fundspark.sources.delimited import read_delimited

FILES = "inf_diario_fi_*.csv"


def file_stream(
    spark: SparkSession, folder: str, pattern: str = FILES, files_per_batch: int = 100
) -> DataFrame:
    """The paths of files as they land, oldest first, once for each of their lines."""
    return (
        spark.readStream.format("text")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
    )


def ingest_daily(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    pattern: str = FILES,
    files_per_batch: int = 100,
    counters: str | None = None,
) -> StreamingQuery:
    """Upsert all files landed so far into ``table``; repeating a batch changes nothing.

    The stream keeps track of the files; each batch reads its files as the batch load does,
    every file in its own layout. ``counters`` names a folder for one row per batch (``lote``):
    its files, the lines read and the rows left of them, counted while they are written; a
    repeated batch writes its row again.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # No more paths than files_per_batch.
        paths = sorted(r.path for r in batch.distinct().collect())
        if not paths:
            return
        spark = batch.sparkSession
        seen = Counters()
        raw = seen.of(read_delimited(spark, paths, bad_lines="fail", renames=schemas.LAYOUT_RENAMES), "lidas")
        daily = seen.of(clean_daily(raw), "gravadas")
        upsert_table(spark, table, daily, schemas.DAILY_KEYS, month_of="dt_comptc")
        if counters:
            row = spark.createDataFrame([(len(paths), *seen.get().values())], "arquivos long, lidas long, gravadas long")
            row.coalesce(1).write.mode("overwrite").parquet(f"{counters}/lote={batch_id}")

    return (
        file_stream(spark, folder, pattern, files_per_batch)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
