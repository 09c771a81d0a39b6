"""Log returns and unit-value series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundspark.functions.numbers import finite_or_null, log_ratio
from fundspark.operators.columns import serve
from fundspark.operators.filters import one_of
from fundspark.operators.ranking import lag_in_group, sorted_by

SERIES = ["cnpj_fundo_classe", "tp_fundo_classe", "id_subclasse"]
SERIES_AMOUNTS = ["captc_dia", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total"]


def log_returns(daily: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``ln`` of each unit value over the previous one; undefined returns are left out.

    A full series has one row per date, so its window is bounded by the calendar.
    With fewer ``keys`` several series interleave and the group size is unknown.
    """
    order = [F.col("dt_comptc"), *[F.col(c) for c in SERIES if c not in keys]]
    rows = daily.select(*SERIES, "dt_comptc", "vl_quota")
    if set(keys) == set(SERIES):
        previous = F.lag("vl_quota").over(W.partitionBy(*SERIES).orderBy("dt_comptc"))
        rows = rows.withColumn("_previous", previous)
    else:
        rows = lag_in_group(rows, keys, order, {"_previous": "vl_quota"})
    value = finite_or_null(log_ratio(F.col("vl_quota"), F.col("_previous")))
    return rows.select(*SERIES, "dt_comptc", value.alias("vl_log_quota")).dropna(
        subset=["vl_log_quota"]
    )


def quota_series(
    daily: DataFrame,
    registry: DataFrame,
    ids: Sequence[str] | DataFrame | None = None,
    types: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Daily rows with the registered name, by date; one row per registration."""
    rows = one_of(one_of(daily, "cnpj_fundo_classe", ids), "tp_fundo_classe", types)
    names = registry.select(F.col("cnpj_fundo").alias("cnpj_fundo_classe"), "denominacao_social")
    series = rows.join(names, "cnpj_fundo_classe", "left").select(
        "cnpj_fundo_classe", "tp_fundo_classe", "dt_comptc", "id_subclasse", "captc_dia",
        "nr_cotst", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total", "denominacao_social",
    )
    return serve(sorted_by(series, F.col("dt_comptc")), zero=SERIES_AMOUNTS)
