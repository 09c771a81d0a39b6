"""Unified portfolio composition and the fund sheet."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.functions.numbers import percent_change
from fundspark.operators.columns import serve
from fundspark.operators.filters import date_range_or_latest, one_of
from fundspark.operators.ranking import (
    has_large_group, lag_in_group, lag_of_small_groups, rank_in_group, rank_of_small_groups,
)
from fundspark.plans.returns import quota_series
from fundspark.schemas import BLOCKS
from fundspark.session import staged

UNIFIED = [
    "cnpj_fundo_classe", "dt_comptc", "tp_fundo_classe", "tp_aplic", "tp_ativo",
    "denominacao_social", "codigo_ativo", "cd_isin", "vl_merc_pos_final", "qt_pos_final",
    "origem_tabela",
]
VEHICLE = ["cnpj_fundo_classe", "tp_fundo_classe"]
ASSET = ["cnpj_fundo_classe", "tp_fundo_classe", "codigo_ativo", "origem_tabela"]
PORTFOLIO_DATE = ["cnpj_fundo_classe", "tp_fundo_classe", "dt_comptc"]


def unified_block(df: DataFrame, block: int) -> DataFrame:
    """One block in the common shape: its asset code, isin and origin tag."""
    origin, code, isin, _ = BLOCKS[block]
    return df.select(
        "cnpj_fundo_classe", "dt_comptc", "tp_fundo_classe", "tp_aplic", "tp_ativo",
        F.col("denom_social").alias("denominacao_social"),
        F.col(code).alias("codigo_ativo"),
        (F.col(isin) if isin else F.lit(None).cast("string")).alias("cd_isin"),
        "vl_merc_pos_final", "qt_pos_final",
        F.lit(origin).alias("origem_tabela"),
    )


def unified_positions(blocks: Mapping[int, DataFrame]) -> DataFrame:
    """UNION ALL of the block tables; filters are pushed into every branch."""
    return reduce(
        DataFrame.unionByName, [unified_block(blocks[b], b) for b in sorted(blocks)]
    )


def unified_from_table(positions: DataFrame) -> DataFrame:
    """The same shape from the single table partitioned by origin: one scan, no union."""
    code = isin = F.lit(None).cast("string")
    for origin, code_column, isin_column, _ in BLOCKS.values():
        here = F.col("origem_tabela") == origin
        code = F.when(here, F.col(code_column)).otherwise(code)
        if isin_column:
            isin = F.when(here, F.col(isin_column)).otherwise(isin)
    return positions.withColumns(
        {"denominacao_social": F.col("denom_social"), "codigo_ativo": code, "cd_isin": isin}
    ).select(*UNIFIED)


def portfolio_composition(
    unified: DataFrame,
    ids: Sequence[str] | DataFrame | None = None,
    types: Sequence[str] | DataFrame | None = None,
    served: bool = True,
    stored: bool = False,
) -> DataFrame:
    """Positions with previous value and date, percent change and rank in the portfolio.

    The serving shape turns a change of exactly 0 % into NULL; ``served=False``
    keeps it and the decimals. Rows that tie in date or value are ordered by all their
    columns, so that previous value and rank do not vary. Rows are staged, as they are read
    twice, unless they come from a ``stored`` table.
    """
    rows = one_of(one_of(unified, "cnpj_fundo_classe", ids), "tp_fundo_classe", types)
    rows = rows if stored else staged(rows, "positions")
    named = [c for c in rows.columns if c not in (*ASSET, "dt_comptc", "tp_aplic", "tp_ativo")]
    ties = [F.col(c).asc_nulls_last() for c in ("tp_aplic", "tp_ativo", *named)]
    by_date = [F.col("dt_comptc").asc_nulls_last(), *ties]
    before = {"vl_merc_pos_final_anterior": "vl_merc_pos_final", "dt_comptc_anterior": "dt_comptc"}
    by_value = [
        F.col("vl_merc_pos_final").desc_nulls_first(),
        F.col("origem_tabela"),
        F.col("codigo_ativo").asc_nulls_last(),
        *ties[:2],
    ]
    change = percent_change(F.col("vl_merc_pos_final"), F.col("vl_merc_pos_final_anterior"))
    # Newest first. The places by asset order equal values as their columns do.
    # A vehicle holds whole assets and portfolios, so that only where one is large these are looked at.
    together = VEHICLE if not has_large_group(rows, VEHICLE) else None
    if together is None and has_large_group(rows, ASSET, PORTFOLIO_DATE):
        lagged = lag_in_group(rows, ASSET, by_date, before, number="_lugar")
        ranked = rank_in_group(
            lagged.withColumn("variacao_percentual", change),
            PORTFOLIO_DATE,
            by_value,
            "ranking_posicao",
            number="_lugar",
            groups=[F.col("dt_comptc").desc_nulls_first(), *map(F.col, PORTFOLIO_DATE[:2])],
        )
    else:
        lagged = lag_of_small_groups(rows, ASSET, by_date, before, number="_lugar", together=together)
        # A number that falls with the date, so that its groups come newest first.
        lagged = lagged.withColumn("_dia", -F.unix_date("dt_comptc"))
        ranked = rank_of_small_groups(
            lagged, ["_dia", *PORTFOLIO_DATE[:2]], [*by_value, F.col("_lugar")], "ranking_posicao"
        )
        # What follows from other columns is not shuffled.
        ranked = ranked.withColumn("variacao_percentual", change)
    rows = ranked.select(*rows.columns, *before, "variacao_percentual", "ranking_posicao")
    if not served:
        return rows
    return serve(
        rows,
        zero=["vl_merc_pos_final", "qt_pos_final"],
        nullable=["vl_merc_pos_final_anterior", "variacao_percentual"],
    )


class FundSheet(NamedTuple):
    series: DataFrame
    composition: DataFrame
    header: DataFrame
    chart: DataFrame


def fund_sheet(
    daily: DataFrame, registry: DataFrame, unified: DataFrame, cnpj: str, tp: str
) -> FundSheet:
    """Series and composition of one vehicle, its newest first position and its chart points."""
    series = quota_series(daily, registry, [cnpj], [tp])
    composition = portfolio_composition(unified, [cnpj], [tp])
    header = composition.orderBy(
        F.col("dt_comptc").desc_nulls_first(), F.col("ranking_posicao")
    ).limit(1)
    return FundSheet(
        series, composition, header, series.select("dt_comptc", "vl_patrim_liq", "vl_quota")
    )


def composition_months(composition: DataFrame) -> DataFrame:
    """The dates a composition offers, oldest first."""
    return composition.select("dt_comptc").distinct().orderBy("dt_comptc")


def fund_sheet_month(composition: DataFrame, month: dt.date | str | None = None) -> DataFrame:
    """Rows of the chosen date, by default the latest."""
    return date_range_or_latest(composition, month, month)
