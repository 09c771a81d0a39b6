"""Tables laid out by the hash of a key: joins without an exchange, upserts of the touched buckets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.operators.keys import merge_upsert, require_keys
from fundspark.session import remove, scratch_path
from fundspark.sinks.parquet import refresh_partitions
from fundspark.sources.tables import path_has_data

BUCKETS = 64
_NAME = re.compile(r"^balde_(\d+)$")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Store ``df`` as the catalog table ``name``, bucketed and sorted by ``key``.

    Tables with the same number of buckets join and group by the key where they lie. ``path``
    puts the files there instead of into the warehouse. Rows are dealt to their buckets
    before they are written, so that a bucket is one file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


# Upserts that touch part of a table ---------------------------------------------------


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_column(df: DataFrame) -> str | None:
    """The partition column of a table stored in hash buckets; it tells their number."""
    return next((c for c in df.columns if _NAME.match(c)), None)


def upsert_buckets(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """Upsert ``source`` into a table in hash buckets of its keys; returns the buckets that were touched.

    Only buckets with a key of the source are read and rewritten. A new table gets ``buckets``
    of them; later upserts find their number in the table. The merged buckets are staged
    before they replace the old ones. A source without rows changes nothing.
    """
    stored = spark.read.parquet(path) if path_has_data(spark, path) else None
    name = (bucket_column(stored) if stored is not None else None) or f"balde_{buckets}"
    number = int(_NAME.match(name)[1])
    landed, merged = scratch_path(spark, "fonte"), scratch_path(spark, "baldes")
    try:
        source.withColumn(name, _bucket(keys, number)).write.parquet(landed)
        fresh = require_keys(spark.read.parquet(landed), keys)
        # No more rows than there are buckets.
        touched = sorted(r[0] for r in fresh.select(name).distinct().collect())
        if not touched:
            return touched
        rows = fresh
        if stored is not None:
            old = stored.select(*fresh.columns).filter(F.col(name).isin(touched))
            rows = merge_upsert(old, fresh, [*keys, name], update_cols)
        rows.write.partitionBy(name).parquet(merged)
        refresh_partitions(spark.read.schema(fresh.schema).parquet(merged), path, [name])
        return touched
    finally:
        remove(spark, landed)
        remove(spark, merged)
