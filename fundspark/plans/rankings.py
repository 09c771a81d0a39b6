"""Manager, flow and equity rankings, dates, counts and the asset histogram.

Joins with the registry come after the daily side is aggregated, and the registry
side is first reduced to unique keys with a multiplicity, so repeated
registrations weigh in without multiplying rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.functions.numbers import in_millions, percent_of
from fundspark.operators import aggregates, filters
from fundspark.operators.columns import serve
from fundspark.operators.keys import dedup_keep
from fundspark.operators.paging import page
from fundspark.operators.ranking import global_rank, sorted_by
from fundspark.schemas import EQUITY_APPLICATION, VEHICLE

FLOW_COLUMNS = [
    "cnpj_fundo_classe", "tp_fundo_classe", "dt_comptc", "denominacao_social", "vl_total",
    "total_resgates", "total_aportes", "fluxo_liquido", "percentual_fluxo_liquido", "ranking",
]
FLOW_AMOUNTS = [
    "vl_total", "total_resgates", "total_aportes", "fluxo_liquido", "percentual_fluxo_liquido",
]


def _times(amount: Column, copies: Column) -> Column:
    return (amount * copies.cast("decimal(10,0)")).cast("decimal(27,2)")


def latest_registration(registry: DataFrame) -> DataFrame:
    """One registry row per tax id: the one with the highest registration id."""
    return dedup_keep(registry, ["cnpj_fundo"], ["id_registro_fundo"])


def manager_aum_ranking(
    daily: DataFrame, registry: DataFrame, dedupe_registry: bool = False
) -> DataFrame:
    """Managers by net assets at each vehicle's latest date with positive assets.

    A tax id registered twice counts twice in the assets (not in the vehicles),
    unless ``dedupe_registry``.
    """
    if dedupe_registry:
        registry = latest_registration(registry)
    return rank_managers(vehicle_assets(daily), registry)


def vehicle_assets(daily: DataFrame) -> DataFrame:
    """Each class fund's latest date with positive assets, and its assets then."""
    funds = filters.positive(filters.class_funds(daily), "vl_patrim_liq")
    return aggregates.total_at_latest_date(funds, "vl_patrim_liq")


def rank_managers(assets: DataFrame, registry: DataFrame) -> DataFrame:
    """Managers by the net assets of their vehicles."""
    managers = (
        filters.named_manager(registry)
        .groupBy(F.col("cnpj_fundo").alias("cnpj_fundo_classe"), "cpf_cnpj_gestor", "gestor")
        .agg(F.count("*").alias("registros"))
    )
    # One row per vehicle and manager from here on, so counting rows counts vehicles.
    per_manager = (
        assets.join(managers, "cnpj_fundo_classe")
        .groupBy("cpf_cnpj_gestor", "gestor")
        .agg(
            F.count("*").alias("numero_veiculos"),
            F.sum(_times(F.col("vl_patrim_liq"), F.col("registros")))
            .cast("decimal(27,2)")
            .alias("patrimonio_total_sob_gestao"),
        )
        .filter(F.col("patrimonio_total_sob_gestao") > 0)
    )
    order = [F.col("patrimonio_total_sob_gestao").desc(), F.col("cpf_cnpj_gestor"), F.col("gestor")]
    return global_rank(per_manager, order).orderBy("ranking")


def flow_sums(daily: DataFrame) -> DataFrame:
    """Redemptions, subscriptions and net flow per fund, day and total.

    A day that reports only one side has no net flow.
    """
    return daily.groupBy(*VEHICLE, "dt_comptc", "vl_total").agg(
        F.sum("resg_dia").alias("total_resgates"),
        F.sum("captc_dia").alias("total_aportes"),
        F.sum(F.col("captc_dia") - F.col("resg_dia")).alias("fluxo_liquido"),
    )


def _with_names(flows: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join with the registry names; a name registered n times counts n times."""
    names = registry.groupBy(
        F.col("cnpj_fundo").alias("cnpj_fundo_classe"), "denominacao_social"
    ).agg(F.count("*").alias("registros"))
    copies = F.coalesce("registros", F.lit(1))
    amounts = ["total_resgates", "total_aportes", "fluxo_liquido"]
    return flows.join(names, "cnpj_fundo_classe", "left").withColumns(
        {a: _times(F.col(a), copies) for a in amounts}
    )


def recent_flows(daily: DataFrame, registry: DataFrame, days: int = 31) -> DataFrame:
    """Named fund days of the last ``days`` days with their net flow, days without net flow left out.

    Tables bucketed by tax id are grouped and joined where they lie.
    """
    return named_flows(fund_flows(filters.last_days(daily, days)), registry)


def fund_flows(daily: DataFrame) -> DataFrame:
    """Fund days with a net flow."""
    return flow_sums(filters.any_flow(daily)).filter(F.col("fluxo_liquido") != 0)


def named_flows(flows: DataFrame, registry: DataFrame) -> DataFrame:
    """Fund days with the registry's names and the flow's share of all assets."""
    return _with_names(flows, registry).withColumn(
        "percentual_fluxo_liquido", percent_of(F.col("fluxo_liquido"), F.col("vl_total"))
    )


def flow_ranking(daily: DataFrame, registry: DataFrame, days: int = 31) -> DataFrame:
    """Fund days of the last ``days`` days by net flow, days without net flow left out."""
    return rank_flows(recent_flows(daily, registry, days))


def rank_flows(named: DataFrame) -> DataFrame:
    """Named fund days by net flow."""
    order = [
        F.col("fluxo_liquido").desc(), F.col("cnpj_fundo_classe"), F.col("tp_fundo_classe"),
        F.col("dt_comptc"), F.col("denominacao_social").asc_nulls_last(),
        F.col("vl_total").asc_nulls_last(),
    ]
    return global_rank(named.select(*FLOW_COLUMNS[:-1]), order).select(*FLOW_COLUMNS).orderBy("ranking")


def flow_ranking_period(daily: DataFrame, registry: DataFrame, period: str = "31_dias") -> DataFrame:
    """Net flow summed over a whole named period, per vehicle."""
    recent = filters.any_flow(filters.trailing_period(daily, period))
    per_vehicle = recent.groupBy(*VEHICLE).agg(
        F.sum("resg_dia").alias("total_resgates"),
        F.sum("captc_dia").alias("total_aportes"),
        F.sum(F.col("captc_dia") - F.col("resg_dia")).alias("fluxo_liquido"),
    )
    named = _with_names(per_vehicle.filter(F.col("fluxo_liquido") != 0), registry).drop("registros")
    order = [F.col("fluxo_liquido").desc(), *[F.col(k) for k in VEHICLE],
             F.col("denominacao_social").asc_nulls_last()]
    return global_rank(named, order).orderBy("ranking")


def flow_ranking_page(
    ranking: DataFrame,
    period: str = "dia",
    number: int = 0,
    size: int = 25,
    filters_by: dict[str, str] | None = None,
    search: str | None = None,
    sort: Sequence[tuple[str, bool]] = (),
) -> DataFrame:
    """One page of a stored flow ranking, with totals; grid filters and sorts optional."""
    rows = filters.trailing_period(ranking, period)
    rows = filters.grid_filter(rows, FLOW_COLUMNS, filters_by, search)
    order = [*filters.grid_sort(FLOW_COLUMNS, sort), F.col("ranking")]
    return serve(page(rows.select(*FLOW_COLUMNS), order, number, size), zero=FLOW_AMOUNTS)


def flow_ranking_range(ranking: DataFrame, start=None, end=None) -> DataFrame:
    """A stored flow ranking within a date range, in rank order."""
    rows = filters.date_range(ranking, start, end).select(*FLOW_COLUMNS).orderBy("ranking")
    return serve(rows, zero=FLOW_AMOUNTS)


def aum_ranking_served(ranking: DataFrame) -> DataFrame:
    rows = ranking.select(
        "ranking", "cpf_cnpj_gestor", "gestor", "numero_veiculos", "patrimonio_total_sob_gestao"
    )
    return serve(rows.orderBy("ranking"), zero=["patrimonio_total_sob_gestao"])


def available_dates(daily: DataFrame) -> DataFrame:
    """Distinct dates, newest first."""
    return daily.select("dt_comptc").distinct().orderBy(F.col("dt_comptc").desc())


def equities(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("tp_aplic") == EQUITY_APPLICATION)


def equity_exposure_ranking(positions: DataFrame, start=None, end=None) -> DataFrame:
    """Vehicles by equity value in a date range, or on the latest date of the table."""
    rows = filters.date_range_or_latest(equities(positions), start, end, among=positions)
    totals = (
        rows.groupBy(*VEHICLE)
        .agg(F.sum("vl_merc_pos_final").alias("valor_total_acao"))
        .filter(F.col("valor_total_acao") > 0)
    )
    order = [F.col("valor_total_acao").desc(), *[F.col(k) for k in VEHICLE]]
    return global_rank(totals, order).orderBy("ranking")


def equity_positions(
    positions: DataFrame, cnpj: str, tp: str, start=None, end=None
) -> DataFrame:
    """Equity rows of one vehicle, newest first."""
    rows = filters.vehicle(equities(positions), cnpj, tp)
    return sorted_by(filters.date_range(rows, start, end), F.col("dt_comptc").desc_nulls_first())


def equity_positions_all(positions: DataFrame) -> DataFrame:
    """All equity rows by value; an unknown value sorts first."""
    return sorted_by(equities(positions), F.col("vl_merc_pos_final").desc_nulls_first())


def vehicle_count(daily: DataFrame) -> DataFrame:
    return aggregates.count_vehicles(daily)


def manager_aum_active(
    daily: DataFrame, registry: DataFrame, exact: bool = False
) -> DataFrame:
    """Net assets by manager name, cancelled funds left out.

    By default a fund's rows on a date count once for every series that ends on
    that date, subclasses not being told apart; ``exact`` takes each series'
    own latest row.
    """
    managers = (
        filters.not_cancelled(registry.filter(F.col("gestor").isNotNull()))
        .groupBy(F.col("cnpj_fundo").alias("cnpj_fundo_classe"), "gestor")
        .agg(F.count("*").alias("registros"))
    )
    if exact:
        per_fund = (
            aggregates.latest_of_series(daily, ["vl_patrim_liq"])
            .groupBy("cnpj_fundo_classe")
            .agg(F.sum("vl_patrim_liq").alias("valor"))
        )
    else:
        ends = (
            aggregates.latest_of_series(daily, [])
            .groupBy("cnpj_fundo_classe", "dt_comptc")
            .agg(F.count("*").alias("series"))
        )
        # One row per fund and end date on the right: daily rows are never multiplied.
        per_fund = (
            daily.select("cnpj_fundo_classe", "dt_comptc", "vl_patrim_liq")
            .join(ends, ["cnpj_fundo_classe", "dt_comptc"])
            .groupBy("cnpj_fundo_classe")
            .agg(F.sum(_times(F.col("vl_patrim_liq"), F.col("series"))).alias("valor"))
        )
    per_manager = (
        per_fund.join(managers, "cnpj_fundo_classe")
        .groupBy("gestor")
        .agg(
            F.sum(_times(F.col("valor").cast("decimal(27,2)"), F.col("registros")))
            .cast("decimal(27,2)")
            .alias("patrimonio_sobre_gestao")
        )
    )
    return per_manager.filter(F.col("patrimonio_sobre_gestao") > 0).orderBy(
        F.col("patrimonio_sobre_gestao").desc(), "gestor"
    )


def manager_aum_histogram(
    managers: DataFrame,
    edges: Sequence[float] = aggregates.BAND_EDGES,
    scale: float = 1.0,
    drop_maximum: bool = False,
) -> DataFrame:
    """Managers per band of net assets in millions; ``scale`` stretches small fixtures.

    ``drop_maximum`` leaves the greatest manager out of the top band.
    """
    millions = managers.select(
        (in_millions(F.col("patrimonio_sobre_gestao")) * scale).alias("patrimonio_milhao")
    )
    return aggregates.band_counts(millions, "patrimonio_milhao", edges, drop_maximum=drop_maximum)
