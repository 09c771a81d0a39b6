"""Log tail: new ``*.log`` files into one partition per arrival day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundspark.functions.dates import day_bucket


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files below ``folder`` with their file and arrival day.

    The file source notices new files, not lines appended to a file it has read.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.log")
        .text(folder)
    )
    return lines.select(
        F.col("value").alias("mensagem"),
        F.col("_metadata.file_name").alias("arquivo"),
        day_bucket(F.current_timestamp()).alias("dia"),
    )


def write_logs(logs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed so far, each line once across restarts."""
    return (
        logs.writeStream.partitionBy("dia")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out, format="parquet", outputMode="append")
    )
