"""Session helpers: shared scratch space and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="fundspark-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fundspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under :func:`scratch_root`, for staged tables."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run in this block are deleted when their query ends.

    Otherwise they stay until the driver collects its garbage, beside what later steps write.
    For writes and single actions: a frame that runs twice in the block shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged; frames that read it are of no use afterwards."""
    remove(spark, scratch_root(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def frozen(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
