"""Shared aggregates: latest rows and fixed-band histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.schemas import DAILY_KEYS, VEHICLE

# Lower band edges in millions, and their labels.
BAND_EDGES = (0, 10, 100, 500, 1000, 5000, 10000)
BAND_LABELS = ("0-10M", "10-100M", "100-500M", "500M-1B", "1-5B", "5-10B", "10B+")


def latest_per_vehicle(daily: DataFrame, name: str = "ultima_data") -> DataFrame:
    return daily.groupBy(*VEHICLE).agg(F.max("dt_comptc").alias(name))


def latest_of_series(daily: DataFrame, values: Sequence[str]) -> DataFrame:
    """The latest daily row of every (fund, type, subclass) series.

    The table is keyed by fund, date, subclass and type, so this is a hash aggregate
    with map-side combine: one scan, and one row per series and task is shuffled.
    """
    series = [k for k in DAILY_KEYS if k != "dt_comptc"]
    return daily.groupBy(*series).agg(
        F.max("dt_comptc").alias("dt_comptc"),
        *[F.max_by(v, "dt_comptc").alias(v) for v in values],
    )


def at_latest_date(daily: DataFrame, values: Sequence[str]) -> DataFrame:
    """The daily rows at each vehicle's latest date, one per subclass reporting then."""
    rows = latest_of_series(daily, values)
    return rows.join(latest_per_vehicle(rows, "dt_comptc"), [*VEHICLE, "dt_comptc"], "left_semi")


def total_at_latest_date(daily: DataFrame, value: str) -> DataFrame:
    """One row per vehicle: its latest date and the sum of ``value`` on that date."""
    per_date = (
        latest_of_series(daily, [value]).groupBy(*VEHICLE, "dt_comptc").agg(F.sum(value).alias(value))
    )
    return per_date.groupBy(*VEHICLE).agg(
        F.max("dt_comptc").alias("dt_comptc"), F.max_by(value, "dt_comptc").alias(value)
    )


def count_vehicles(daily: DataFrame) -> DataFrame:
    """How many (fund, subclass, type) series exist."""
    series = daily.select("cnpj_fundo_classe", "id_subclasse", "tp_fundo_classe").distinct()
    return series.agg(F.count("*").alias("numero_veiculos"))


def band_counts(
    df: DataFrame,
    column: str,
    edges: Sequence[float] = BAND_EDGES,
    labels: Sequence[str] = BAND_LABELS,
    drop_maximum: bool = False,
) -> DataFrame:
    """Rows per left-closed band, in band order, empty bands included.

    One global aggregate turned into one row per band. The top band is open;
    ``drop_maximum`` closes it at the greatest value and excludes that value, and
    fails when no value lies above the last edge.
    """
    value = F.col(column)

    def inside(i: int) -> Column:
        if i + 1 < len(edges):
            return (value >= edges[i]) & (value < edges[i + 1])
        return value >= edges[i]

    counts = [F.count_if(inside(i)).alias(f"b{i}") for i in range(len(edges))]
    if drop_maximum:
        top = df.agg(F.max(column).alias("m")).scalar()
        bound = F.when(top > edges[-1], top).otherwise(
            F.raise_error(F.lit("the greatest value must lie above the last edge"))
        )
        counts[-1] = F.count_if(inside(len(edges) - 1) & (value < bound)).alias(f"b{len(edges) - 1}")
    bands = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordem"), F.lit(label).alias("faixa_patrimonio"),
                F.col(f"b{i}").alias("gestores"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return df.agg(*counts).select(F.inline(bands))
