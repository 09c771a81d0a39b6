"""User-level queries on hand-made edge rows and as properties of the test tables."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark import schemas
from fundspark.operators import ranking
from fundspark.plans import loaders, portfolio, rankings, returns, screening

D1, D2, D3 = (dt.date(2024, 1, n) for n in (1, 2, 3))
FIF, FI = "CLASSES - FIF", "FI"


def daily(spark, *lines):
    """Rows of (fund, type, subclass, date, subscriptions, redemptions, assets, quota, total)."""
    names = "cnpj_fundo_classe tp_fundo_classe id_subclasse dt_comptc captc_dia resg_dia vl_patrim_liq vl_quota vl_total"
    money = {"captc_dia", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total"}
    kinds = [f"{n} {'string' if n in money else 'date' if n == 'dt_comptc' else 'string'}" for n in names.split()]
    rows = [tuple(v if v is None or isinstance(v, (str, dt.date)) else str(v) for v in line) for line in lines]
    df = spark.createDataFrame(rows, ", ".join(kinds)).withColumn("nr_cotst", F.lit(1))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.DAILY])


def registry(spark, *lines):
    kind = "id_registro_fundo long, cnpj_fundo string, denominacao_social string, situacao string, cpf_cnpj_gestor string, gestor string"
    return spark.createDataFrame(list(lines), kind)


ONE = (1, "a", "Fundo A", "Ativo", "1", "G")


# Manager assets ---------------------------------------------------------------------


def test_all_subclasses_of_the_latest_date_count(spark, rows):
    table = daily(
        spark, ("a", FIF, "S1", D2, 0, 0, 10, 1, 1), ("a", FIF, "S2", D2, 0, 0, 20, 1, 1),
        ("a", FIF, "S3", D1, 0, 0, 99, 1, 1), ("a", FI, "NA", D2, 0, 0, 99, 1, 1),
        ("a", FIF, "S1", D3, 0, 0, -5, 1, 1),
    )
    ranked = rankings.manager_aum_ranking(table, registry(spark, ONE))
    assert rows(ranked, "gestor", "numero_veiculos", "patrimonio_total_sob_gestao") == [("G", 1, Decimal("30.00"))]


def test_a_repeated_registration_doubles_assets_unless_deduplicated(spark, rows):
    table = daily(spark, ("a", FIF, "NA", D1, 0, 0, 10, 1, 1))
    twice = registry(spark, ONE, (2, "a", "Fundo A", "Ativo", "1", "G"))
    shown = ("numero_veiculos", "patrimonio_total_sob_gestao")
    assert rows(rankings.manager_aum_ranking(table, twice), *shown) == [(1, Decimal("20.00"))]
    assert rows(rankings.manager_aum_ranking(table, twice, dedupe_registry=True), *shown) == [(1, Decimal("10.00"))]


def test_active_assets_multiply_subclasses_unless_exact(spark, rows):
    table = daily(spark, ("a", FIF, "S1", D1, 0, 0, 10, 1, 1), ("a", FIF, "S2", D1, 0, 0, 20, 1, 1))
    assert rows(rankings.manager_aum_active(table, registry(spark, ONE))) == [("G", Decimal("60.00"))]
    assert rows(rankings.manager_aum_active(table, registry(spark, ONE), exact=True)) == [("G", Decimal("30.00"))]


def test_unknown_and_cancelled_status_is_left_out(spark):
    table = daily(spark, ("a", FIF, "NA", D1, 0, 0, 10, 1, 1))
    for status in ("Cancelado", None):
        assert rankings.manager_aum_active(table, registry(spark, (1, "a", "A", status, "1", "G"))).count() == 0


# Flows --------------------------------------------------------------------------------


def test_half_reported_and_balanced_days_have_no_net_flow(spark, rows):
    table = daily(
        spark, ("a", FI, "NA", D1, 5, None, 1, 1, 100), ("a", FI, "NA", D2, None, 5, 1, 1, 100),
        ("b", FI, "NA", D1, 5, 5, 1, 1, 100), ("c", FI, "NA", D1, None, None, 1, 1, 100),
        ("d", FI, "NA", D1, 7, 5, 1, 1, 0), ("e", FI, "NA", D1, 7, 5, 1, 1, 80),
    )
    ranked = rankings.flow_ranking(table, registry(spark, ONE))
    assert rows(ranked, "cnpj_fundo_classe", "fluxo_liquido", "percentual_fluxo_liquido", "ranking") == [
        ("d", Decimal("2.00"), Decimal("0.00"), 1), ("e", Decimal("2.00"), Decimal("2.50"), 2),
    ]


def test_flow_of_a_tiny_total_has_no_percentage(spark):
    table = daily(spark, ("a", FI, "NA", D1, 9_000_000, 1, 1, 1, "0.01"))
    assert rankings.flow_ranking(table, registry(spark, ONE)).first().percentual_fluxo_liquido is None


def test_flow_window_is_31_days_inclusive(spark, rows):
    last = dt.date(2024, 3, 31)
    table = daily(spark, *[("a", FI, "NA", last - dt.timedelta(n), n + 1, 0, 1, 1, 1) for n in (0, 31, 32)])
    ranked = rankings.flow_ranking(table, registry(spark, ONE))
    assert rows(ranked, "dt_comptc") == [(last - dt.timedelta(31),), (last,)]


def test_flow_ranking_properties(spark, sf_dir):
    ranking = rankings.flow_ranking(fx.daily(spark, sf_dir), fx.registry(spark, sf_dir)).collect()
    assert [r.ranking for r in ranking] == list(range(1, len(ranking) + 1))
    flows = [r.fluxo_liquido for r in ranking]
    assert flows == sorted(flows, reverse=True)


# Returns ------------------------------------------------------------------------------------


def test_zero_and_missing_quotas_have_no_return(spark, rows):
    days = [dt.date(2024, 1, n) for n in range(1, 7)]
    table = daily(spark, *[("a", FI, "NA", d, 0, 0, 1, q, 1) for d, q in zip(days, (1, 2, 0, 4, None, 8))])
    assert rows(returns.log_returns(table), "dt_comptc", "vl_log_quota") == [(days[1], math.log(2))]


def test_subclasses_are_separate_series(spark):
    table = daily(
        spark, ("a", FI, "S1", D1, 0, 0, 1, 1, 1), ("a", FI, "S2", D2, 0, 0, 1, 2, 1), ("a", FI, "S1", D3, 0, 0, 1, 4, 1)
    )
    assert [r.vl_log_quota for r in returns.log_returns(table).collect()] == [math.log(4)]
    interleaved = returns.log_returns(table, ["cnpj_fundo_classe"]).orderBy("dt_comptc").collect()
    assert [r.vl_log_quota for r in interleaved] == [math.log(2), math.log(2)]


def test_log_returns_add_up(spark, sf_dir):
    table = fx.daily(spark, sf_dir).filter("vl_quota > 0")
    series = returns.SERIES
    ends = table.groupBy(*series).agg(
        F.min_by("vl_quota", "dt_comptc").cast("double").alias("a"), F.max_by("vl_quota", "dt_comptc").cast("double").alias("b")
    )
    total = returns.log_returns(table).groupBy(*series).agg(F.sum("vl_log_quota").alias("s"))
    joined = ends.join(total, series).collect()
    assert joined and all(abs(r.s - math.log(r.b / r.a)) < 1e-9 for r in joined)


# Portfolio --------------------------------------------------------------------------------------


def positions(spark, *lines):
    kind = "dt_comptc date, tp_ativo string, codigo_ativo string, vl_merc_pos_final decimal(19,2)"
    df = spark.createDataFrame([(d, a, c, None if v is None else Decimal(v)) for d, a, c, v in lines], kind)
    fixed = {"cnpj_fundo_classe": "f", "tp_fundo_classe": FI, "tp_aplic": "Ações", "denominacao_social": "F",
             "cd_isin": None, "origem_tabela": "SWAPS"}
    df = df.withColumns({k: F.lit(v).cast("string") for k, v in fixed.items()})
    return df.withColumn("qt_pos_final", F.lit(None).cast("decimal(21,6)")).select(*portfolio.UNIFIED)


def test_unknown_values_rank_first_and_unchanged_values_serve_as_null(spark, rows):
    table = positions(
        spark, (D1, "x", "A", 10), (D2, "x", "A", 10), (D2, "x", "B", None), (D2, "x", "C", 10),
        (D3, "x", "A", 15), (None, "x", "A", 1),
    )
    shown = ("dt_comptc", "codigo_ativo", "ranking_posicao", "variacao_percentual", "dt_comptc_anterior")
    assert rows(portfolio.portfolio_composition(table), *shown) == [
        (None, "A", 1, (1 - 15) / 15 * 100, D3), (D1, "A", 1, None, None), (D2, "A", 2, None, D1),
        (D2, "B", 1, None, None), (D2, "C", 3, None, None), (D3, "A", 1, 50.0, D2),
    ]
    raw = portfolio.portfolio_composition(table, served=False).filter("dt_comptc = '2024-01-02' and codigo_ativo = 'A'")
    assert raw.first().variacao_percentual == 0.0


def test_composition_does_not_depend_on_the_pieces(spark, rows, sf_dir):
    table = fx.unified(spark, sf_dir)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    whole = rows(portfolio.portfolio_composition(table))
    spark.conf.set(name, "false")
    try:
        assert rows(portfolio.portfolio_composition(table)) == whole
    finally:
        spark.conf.set(name, "true")


def test_ties_are_ordered_by_all_columns(spark, rows, sf_dir):
    """Several rows of one asset on one date: previous value and rank do not depend on the input's order."""
    table = fx.unified(spark, sf_dir)
    table = table.unionByName(table.withColumn("qt_pos_final", F.col("qt_pos_final") + 1))
    assert rows(portfolio.portfolio_composition(table.repartition(5))) == rows(portfolio.portfolio_composition(table.repartition(3)))


def test_newest_positions_come_first(spark, sf_dir):
    dates = [r.dt_comptc for r in portfolio.portfolio_composition(fx.unified(spark, sf_dir)).collect()]
    assert dates == sorted(dates, reverse=True)


# Histogram, screening, baskets, silver ---------------------------------------------------------------


def test_histogram_of_managers(spark):
    managers = spark.createDataFrame([("a", Decimal("5e6")), ("b", Decimal("2e10"))], "gestor string, patrimonio_sobre_gestao decimal(27,2)")
    bands = rankings.manager_aum_histogram(managers).collect()
    assert [b.gestores for b in bands] == [1, 0, 0, 0, 0, 0, 1]
    assert [b.gestores for b in rankings.manager_aum_histogram(managers, drop_maximum=True).collect()][-1] == 0


def test_short_lookup_terms_find_nothing(spark):
    table = registry(spark, (1, "00000000000191", "Fundo A", "Ativo", "1", "G"))
    assert screening.find_funds(table, "Fu").count() == 0
    found = screening.find_funds(table, "fundo").first()
    assert (found.label, found.tipo) == ("Denominação: Fundo A", "Denominação Social")
    assert screening.find_funds(table, "00.000").first().value == "00.000.000/0001-91"


def test_baskets(spark, rows):
    table = spark.createDataFrame([(1, "Alpha", "", ["00.000.000/0001-91"]), (2, "Beta", "", [])], schemas.BASKETS)
    assert screening.create_basket(table, 3, "  ") is table
    grown = screening.create_basket(table, 3, " Gama ")
    assert rows(screening.find_baskets(grown, "MA"), "name") == [("Gama",)]
    assert rows(screening.basket_members(grown)) == [(1, "Alpha", "00000000000191")]


def test_silver_tables_are_replaced(spark, sf_dir, tmp_path):
    table, names = fx.daily(spark, sf_dir), fx.registry(spark, sf_dir)
    for _run in range(2):
        paths = loaders.refresh_silver(table, names, str(tmp_path))
    dates = spark.read.parquet(paths["datas_informacao_diaria"])
    assert dates.count() == dates.select("dt_comptc").distinct().count() > 0
    stored = spark.read.parquet(paths["ranking_movimentacao"])
    assert stored.columns == schemas.FLOW_RANKING.fieldNames()
    page = rankings.flow_ranking_page(stored, "31_dias", 0, 10).collect()
    assert [r.ranking for r in page] == list(range(1, 11))


def test_composition_of_small_groups_and_of_large_ones(spark, monkeypatch):
    """Copies, ties and NULLs give the same rows in the same order by one window each and piece by piece."""
    day = F.when(F.col("id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")))
    unified = spark.range(600).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2).cast("string")).alias("cnpj_fundo_classe"), day.alias("dt_comptc"),
        F.lit("FI").alias("tp_fundo_classe"), F.lit("Ações").alias("tp_aplic"),
        F.when(F.col("id") % 5 != 0, "O").alias("tp_ativo"), F.lit("Fundo").alias("denominacao_social"),
        (F.col("id") % 4).cast("string").alias("codigo_ativo"), F.lit(None).cast("string").alias("cd_isin"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 6).cast("decimal(19,2)").alias("vl_merc_pos_final"),
        F.lit(1).cast("decimal(21,6)").alias("qt_pos_final"), F.lit("SWAPS").alias("origem_tabela"),
    )
    pieces = []
    monkeypatch.setattr(
        portfolio, "lag_in_group", lambda *args, real=portfolio.lag_in_group, **more: pieces.append(1) or real(*args, **more)
    )
    small = portfolio.portfolio_composition(unified)
    shuffles = str(small._jdf.queryExecution().optimizedPlan()).count("Repartition")
    found = [tuple(r) for r in small.collect()]
    assert shuffles == 2 and not pieces
    monkeypatch.setattr(ranking, "GROUP_ROWS", 20)
    assert ranking.has_large_group(unified, portfolio.ASSET, portfolio.PORTFOLIO_DATE)
    large = portfolio.portfolio_composition(unified)
    assert [tuple(r) for r in large.collect()] == found and large.dtypes == small.dtypes
    assert pieces
    days = [r[1] for r in found]
    assert days == sorted(days, key=lambda d: (d is not None, -d.toordinal() if d else 0))


def test_composition_of_large_vehicles_and_what_it_shuffles(spark, monkeypatch):
    """Rows are dealt by vehicle unless one is large, then by asset; the change in percent is not shuffled."""
    month = F.add_months(F.lit("2024-01-31").cast("date"), (F.col("id") % 5).cast("int"))
    unified = spark.range(900).select(
        F.when(F.col("id") % 9 != 0, (F.col("id") % 3).cast("string")).alias("cnpj_fundo_classe"),
        F.when(F.col("id") % 31 != 0, month).alias("dt_comptc"),
        F.when(F.col("id") % 2 == 0, FI).otherwise(FIF).alias("tp_fundo_classe"), F.lit("Ações").alias("tp_aplic"),
        F.lit("O").alias("tp_ativo"), F.lit("Fundo").alias("denominacao_social"),
        F.when(F.col("id") % 17 != 0, (F.col("id") % 4).cast("string")).alias("codigo_ativo"),
        F.lit(None).cast("string").alias("cd_isin"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 7 + 1).cast("decimal(19,2)").alias("vl_merc_pos_final"),
        F.lit(1).cast("decimal(21,6)").alias("qt_pos_final"), F.lit("SWAPS").alias("origem_tabela"),
    )
    by_vehicle = portfolio.portfolio_composition(unified)
    plan = by_vehicle._jdf.queryExecution().optimizedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(shuffles) == 2 and "codigo_ativo" not in shuffles[1]
    assert "variacao_percentual" not in plan[plan.index(shuffles[0]):]
    groups = [unified.groupBy(*keys).count() for keys in (portfolio.ASSET, portfolio.PORTFOLIO_DATE)]
    largest = max(r["count"] for counts in groups for r in counts.collect())
    monkeypatch.setattr(ranking, "GROUP_ROWS", largest)
    assert ranking.has_large_group(unified, portfolio.VEHICLE)
    assert not ranking.has_large_group(unified, portfolio.ASSET, portfolio.PORTFOLIO_DATE)
    by_asset = portfolio.portfolio_composition(unified)
    plan = by_asset._jdf.queryExecution().optimizedPlan().toString()
    assert "codigo_ativo" in [line for line in plan.splitlines() if "RepartitionByExpression" in line][1]
    assert [tuple(r) for r in by_asset.collect()] == [tuple(r) for r in by_vehicle.collect()]
