"""Derived tables that follow the loads: only what a load has changed is aggregated anew.

Between the daily table and the rankings stand two small tables: the flows of every fund day,
partitioned by month, and the assets of every vehicle at its latest date, in hash buckets. A load
touches the months of its dates and the buckets of its vehicles; the rankings themselves, whose
numbers may all shift, are made from these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.operators.filters import MONTH, date_range
from fundspark.operators.keys import with_parent
from fundspark.plans import rankings
from fundspark.plans.loaders import store_silver
from fundspark.schemas import VEHICLE
from fundspark.session import remove, scratch_path
from fundspark.sinks import parquet
from fundspark.sinks.bucketed import upsert_buckets
from fundspark.sources.tables import path_has_data

FLOWS, ASSETS, DATES = "estado_fluxos", "estado_patrimonios", "estado_datas"


def refresh_silver_changed(
    spark: SparkSession, daily: DataFrame, registry: DataFrame, folder: str, changed: DataFrame, days: int = 31
) -> dict[str, str]:
    """Bring the silver tables under ``folder`` up to date after an upsert and return their paths.

    ``daily`` is the stored table with its month column, ``changed`` the keys of the rows that
    were upserted since the last refresh (more do no harm). The result equals that of a full
    refresh. The first call builds all; an interrupted one can be repeated with the same keys.
    """
    root = folder.rstrip("/")
    first = not path_has_data(spark, f"{root}/{DATES}")
    landed = scratch_path(spark, "alterados")
    changed = daily if first else changed
    parquet.with_month(changed.select(*VEHICLE, "dt_comptc").distinct()).write.parquet(landed)
    try:
        _update(spark, daily, spark.read.parquet(landed), root)
    finally:
        remove(spark, landed)
    dates = spark.read.parquet(f"{root}/{DATES}")
    newest = dates.agg(F.max("dt_comptc").alias("d")).first()[0]
    flows = spark.read.parquet(f"{root}/{FLOWS}") if path_has_data(spark, f"{root}/{FLOWS}") else (
        rankings.fund_flows(daily.limit(0)).withColumn(MONTH, F.lit(0))
    )
    recent = date_range(flows, start=F.date_sub(F.lit(newest), days)).drop(MONTH)
    assets = spark.read.parquet(f"{root}/{ASSETS}").filter(F.col("vl_patrim_liq").isNotNull())
    return store_silver(
        {
            "ranking_gestores": rankings.rank_managers(assets.select(*VEHICLE, "dt_comptc", "vl_patrim_liq"), registry),
            "ranking_movimentacao": rankings.rank_flows(rankings.named_flows(recent, registry)),
            "datas_informacao_diaria": dates.orderBy(F.col("dt_comptc").desc()),
        },
        root,
    )


def _update(spark: SparkSession, daily: DataFrame, changed: DataFrame, root: str) -> None:
    """The state after the changed keys; the dates come last, as they tell that there is a state."""
    # No more months, and no more dates, than the calendar has.
    months = sorted(r[0] for r in changed.select(MONTH).distinct().collect())
    if not months:
        return
    touched = daily.filter(F.col(MONTH).cast("string").isin([str(m) for m in months]))
    parquet.refresh_partitions(parquet.with_month(rankings.fund_flows(touched)), f"{root}/{FLOWS}", [MONTH])
    _drop_empty_months(spark, touched, months, f"{root}/{FLOWS}")

    vehicles = changed.select(*VEHICLE).distinct()
    assets = rankings.vehicle_assets(with_parent(daily, vehicles, VEHICLE))
    # A vehicle without positive assets is kept with NULL, which takes the place of what it had.
    upsert_buckets(spark, f"{root}/{ASSETS}", vehicles.join(assets, VEHICLE, "left"), VEHICLE)

    dates = changed.select("dt_comptc").distinct()
    if path_has_data(spark, f"{root}/{DATES}"):
        dates = dates.unionByName(spark.read.parquet(f"{root}/{DATES}").select("dt_comptc")).distinct()
    parquet.refresh(dates, f"{root}/{DATES}")


def _drop_empty_months(spark: SparkSession, touched: DataFrame, months: list, path: str) -> None:
    """Months that have lost their last flow have no rows to replace the old ones with."""
    left = {str(r[0]) for r in rankings.fund_flows(touched).select(F.date_format("dt_comptc", "yyyyMM")).distinct().collect()}
    for month in {str(m) for m in months} - left:
        remove(spark, f"{path}/{MONTH}={month}")
