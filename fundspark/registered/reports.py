"""The registered reports: each takes ``(spark, sf_dir)`` and returns a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark.functions.text import strip_tax_id
from fundspark.operators.columns import serve
from fundspark.operators.paging import page_after
from fundspark.plans import portfolio, rankings, returns, screening
from fundspark.registered.base import doubles, register
from fundspark.session import scratch_path

FUND = ("00000000000003", "CLASSES - FIF")


def _daily_registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.daily(spark, sf), fx.registry(spark, sf)


def _flow_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.flow_ranking(*_daily_registry(spark, sf))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return doubles(screening.fund_facts(*_daily_registry(spark, sf)))


def _composition(spark: SparkSession, sf: str) -> DataFrame:
    cnpj, tp = FUND
    return portfolio.portfolio_composition(fx.unified(spark, sf), [cnpj], [tp])


def _sheet(spark: SparkSession, sf: str) -> portfolio.FundSheet:
    return portfolio.fund_sheet(*_daily_registry(spark, sf), fx.unified(spark, sf), *FUND)


# Manager and flow rankings --------------------------------------------------


@register("manager_aum_ranking")
def _(spark, sf):
    return rankings.aum_ranking_served(rankings.manager_aum_ranking(*_daily_registry(spark, sf)))


@register("manager_aum_ranking_one_registration")
def _(spark, sf):
    ranking = rankings.manager_aum_ranking(*_daily_registry(spark, sf), dedupe_registry=True)
    return rankings.aum_ranking_served(ranking)


@register("flow_ranking")
def _(spark, sf):
    return serve(_flow_ranking(spark, sf), zero=rankings.FLOW_AMOUNTS)


@register("flow_ranking_period")
def _(spark, sf):
    return doubles(rankings.flow_ranking_period(*_daily_registry(spark, sf), "7_dias"))


@register("flow_ranking_page_day")
def _(spark, sf):
    return rankings.flow_ranking_page(_flow_ranking(spark, sf), "dia", 0, 25)


@register("flow_ranking_page_7_days")
def _(spark, sf):
    return rankings.flow_ranking_page(_flow_ranking(spark, sf), "7_dias", 1, 10)


@register("flow_ranking_page_31_days")
def _(spark, sf):
    return rankings.flow_ranking_page(_flow_ranking(spark, sf), "31_dias", 2, 20)


@register("flow_ranking_page_filtered")
def _(spark, sf):
    return rankings.flow_ranking_page(
        _flow_ranking(spark, sf), "31_dias", 0, 50,
        filters_by={"tp_fundo_classe": "fidc"}, search="CUSTOMER#",
        sort=[("denominacao_social", True)],
    )


@register("flow_ranking_after")
def _(spark, sf):
    return serve(page_after(_flow_ranking(spark, sf), "ranking", 40), zero=rankings.FLOW_AMOUNTS)


@register("flow_ranking_range")
def _(spark, sf):
    return rankings.flow_ranking_range(_flow_ranking(spark, sf), "2024-01-10", "2024-01-20")


@register("flow_ranking_from")
def _(spark, sf):
    return rankings.flow_ranking_range(_flow_ranking(spark, sf), start="2024-01-20")


@register("flow_ranking_until")
def _(spark, sf):
    return rankings.flow_ranking_range(_flow_ranking(spark, sf), end="2024-01-10")


@register("available_dates")
def _(spark, sf):
    return rankings.available_dates(fx.daily(spark, sf))


# Equities -------------------------------------------------------------------


@register("equity_exposure_latest")
def _(spark, sf):
    return doubles(rankings.equity_exposure_ranking(fx.portfolio(spark, sf)))


@register("equity_exposure_range")
def _(spark, sf):
    return doubles(
        rankings.equity_exposure_ranking(fx.portfolio(spark, sf), "1996-01-01", "1997-12-31")
    )


@register("equity_positions")
def _(spark, sf):
    return doubles(rankings.equity_positions(fx.portfolio(spark, sf), *FUND, start="1996-01-01"))


@register("equity_positions_all")
def _(spark, sf):
    return doubles(rankings.equity_positions_all(fx.portfolio(spark, sf)))


# Portfolio composition and fund sheet ----------------------------------------


@register("portfolio_composition")
def _(spark, sf):
    return portfolio.portfolio_composition(fx.unified(spark, sf))


@register("portfolio_composition_some")
def _(spark, sf):
    return portfolio.portfolio_composition(
        fx.unified(spark, sf), ["00000000000003", "00000000000007"], ["CLASSES - FIF", "FI"]
    )


@register("portfolio_composition_by_list")
def _(spark, sf):
    listed = fx.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 4000)
    ids = listed.select(F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("cnpj"))
    return portfolio.portfolio_composition(fx.unified(spark, sf), ids)


@register("unified_positions")
def _(spark, sf):
    return doubles(portfolio.unified_positions(fx.blocks(spark, sf)))


@register("quota_series")
def _(spark, sf):
    return returns.quota_series(*_daily_registry(spark, sf))


@register("quota_series_some")
def _(spark, sf):
    return returns.quota_series(
        *_daily_registry(spark, sf), ["00000000000007", "00000000000021"], ["FI", "CLASSES - FIF"]
    )


@register("fund_sheet_series")
def _(spark, sf):
    return _sheet(spark, sf).series


@register("fund_sheet_chart")
def _(spark, sf):
    return _sheet(spark, sf).chart


@register("fund_sheet_composition")
def _(spark, sf):
    return _sheet(spark, sf).composition


@register("fund_sheet_header")
def _(spark, sf):
    return _sheet(spark, sf).header


@register("fund_sheet_months")
def _(spark, sf):
    return portfolio.composition_months(_composition(spark, sf))


@register("fund_sheet_month_latest")
def _(spark, sf):
    return portfolio.fund_sheet_month(_composition(spark, sf))


@register("fund_sheet_month_chosen")
def _(spark, sf):
    return portfolio.fund_sheet_month(_composition(spark, sf), "1997-05-01")


# Returns ----------------------------------------------------------------------


def _rounded_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("vl_log_quota", F.round("vl_log_quota", 6))


@register("log_returns")
def _(spark, sf):
    return _rounded_returns(returns.log_returns(fx.daily(spark, sf)))


@register("log_returns_by_fund")
def _(spark, sf):
    return _rounded_returns(returns.log_returns(fx.daily(spark, sf), ["cnpj_fundo_classe"]))


# Counts, active managers, histogram ---------------------------------------------


@register("vehicle_count")
def _(spark, sf):
    return rankings.vehicle_count(fx.daily(spark, sf))


@register("manager_aum_active")
def _(spark, sf):
    return doubles(rankings.manager_aum_active(*_daily_registry(spark, sf)))


@register("manager_aum_active_exact")
def _(spark, sf):
    return doubles(rankings.manager_aum_active(*_daily_registry(spark, sf), exact=True))


@register("manager_aum_histogram")
def _(spark, sf):
    managers = rankings.manager_aum_active(*_daily_registry(spark, sf))
    return rankings.manager_aum_histogram(managers, scale=1e6)


@register("manager_aum_histogram_closed")
def _(spark, sf):
    managers = rankings.manager_aum_active(*_daily_registry(spark, sf))
    return rankings.manager_aum_histogram(managers, scale=1e9, drop_maximum=True)


# Screening, lookup, baskets --------------------------------------------------------


@register("screen_funds")
def _(spark, sf):
    return screening.screen_funds(_facts(spark, sf), name="ER#0000", assets=(5, 500))


@register("screen_funds_by_holders")
def _(spark, sf):
    return screening.screen_funds(_facts(spark, sf), name="xy", holders=2)


@register("screen_funds_capped")
def _(spark, sf):
    return screening.screen_funds_capped(_facts(spark, sf), holders=1)


@register("find_funds_by_id")
def _(spark, sf):
    return screening.find_funds(fx.registry(spark, sf), "00.000.000/0001")


@register("find_funds_by_name")
def _(spark, sf):
    return screening.find_funds(fx.registry(spark, sf), "00 b")


def _index(spark: SparkSession, sf: str) -> str:
    return screening.index_funds(fx.registry(spark, sf), scratch_path(spark, "indice"))


@register("find_funds_indexed")
def _(spark, sf):
    return screening.find_funds_indexed(spark, _index(spark, sf), "00 b")


@register("find_funds_indexed_by_id")
def _(spark, sf):
    return screening.find_funds_indexed(spark, _index(spark, sf), "00.000.000/0001")


@register("screen_funds_indexed")
def _(spark, sf):
    return screening.screen_funds_indexed(_facts(spark, sf), _index(spark, sf), "ER#0000", assets=(5, 500))


def _members(baskets: DataFrame) -> DataFrame:
    """Baskets with their members' digits in order."""
    members = F.array_sort(F.transform("cnpjs", strip_tax_id))
    return baskets.select("id", "name", F.array_join(members, ",").alias("membros"))


@register("basket_holdings")
def _(spark, sf):
    return screening.basket_holdings(fx.baskets(spark, sf), _facts(spark, sf))


@register("find_baskets")
def _(spark, sf):
    return _members(screening.find_baskets(fx.baskets(spark, sf), "ET 1"))


@register("create_basket")
def _(spark, sf):
    return _members(screening.create_basket(fx.baskets(spark, sf), -1, "  Nova "))
