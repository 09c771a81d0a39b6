"""DuckDB SQL of the registered reports."""

from __future__ import annotations

from fundspark.registered.domain_sql import FX, sql

FLOW = (
    "cnpj_fundo_classe, tp_fundo_classe, dt_comptc, denominacao_social, vl_total, total_resgates,"
    " total_aportes, fluxo_liquido, percentual_fluxo_liquido, ranking"
)
LATEST_FLOW = "(SELECT MAX(dt_comptc) FROM flow)"


def _page(where: str, number: int, size: int, order: str = "ranking") -> str:
    return sql(
        f"""SELECT {FLOW}, (SELECT COUNT(*) FROM flow WHERE {where}) AS total, {number} AS page, {size} AS page_size,
  CAST(ceil((SELECT COUNT(*) FROM flow WHERE {where}) / {size}) AS BIGINT) AS total_pages
FROM flow WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {number * size}"""
    )


def _bands(values: str, closed: bool) -> str:
    edges = [0, 10, 100, 500, 1000, 5000, 10000]
    labels = ["0-10M", "10-100M", "100-500M", "500M-1B", "1-5B", "5-10B", "10B+"]
    rows = []
    for i, (low, label) in enumerate(zip(edges, labels)):
        high = f"v < {edges[i + 1]}" if i + 1 < len(edges) else (
            "v < (SELECT MAX(v) FROM vals)" if closed else "TRUE")
        rows.append(
            f"SELECT {i} AS ordem, '{label}' AS faixa_patrimonio,"
            f" COUNT(*) AS gestores FROM vals WHERE v >= {low} AND {high}"
        )
    return sql(" UNION ALL ".join(rows), vals=values)


EQUITY = "(SELECT * FROM fx_portfolio WHERE tp_aplic = 'Ações')"
EQUITY_COLUMNS = (
    "tipo, cnpj_fundo_classe, dt_comptc, tp_fundo_classe, tp_aplic, tp_ativo, codigo_ativo,"
    " CAST(vl_merc_pos_final AS DOUBLE) AS vl_merc_pos_final, CAST(qt_pos_final AS DOUBLE) AS qt_pos_final"
)


def _exposure(where: str) -> str:
    return sql(
        f"""SELECT cnpj_fundo_classe, tp_fundo_classe, CAST(SUM(vl_merc_pos_final) AS DOUBLE) AS valor_total_acao,
  ROW_NUMBER() OVER (ORDER BY SUM(vl_merc_pos_final) DESC, cnpj_fundo_classe, tp_fundo_classe) AS ranking
FROM {EQUITY} WHERE {where} GROUP BY 1, 2 HAVING SUM(vl_merc_pos_final) > 0"""
    )


def _returns(partition: str, order: str) -> str:
    return sql(
        f"""SELECT cnpj_fundo_classe, tp_fundo_classe, id_subclasse, dt_comptc,
  round(ln(CAST(vl_quota AS DOUBLE) / CAST(p AS DOUBLE)), 6) AS vl_log_quota
FROM (SELECT *, LAG(vl_quota) OVER (PARTITION BY {partition} ORDER BY {order}) AS p FROM fx_daily) WHERE vl_quota > 0 AND p > 0"""
    )


ORACLE: dict[str, str] = {
    "manager_aum_ranking": sql(
        """SELECT ROW_NUMBER() OVER (ORDER BY patrimonio DESC, cpf_cnpj_gestor, gestor) AS ranking, cpf_cnpj_gestor, gestor,
  numero_veiculos, CAST(patrimonio AS DOUBLE) AS patrimonio_total_sob_gestao FROM aum"""
    ),
    "manager_aum_ranking_one_registration": sql(
        """SELECT ROW_NUMBER() OVER (ORDER BY patrimonio DESC, cpf_cnpj_gestor, gestor) AS ranking, cpf_cnpj_gestor, gestor,
  numero_veiculos, CAST(patrimonio AS DOUBLE) AS patrimonio_total_sob_gestao FROM aum""",
        all_rows=FX["fx_registry"],
        fx_registry="SELECT * FROM all_rows QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj_fundo ORDER BY id_registro_fundo DESC) = 1",
    ),
    "flow_ranking": sql(f"SELECT {FLOW} FROM flow"),
    "flow_ranking_period": sql(
        """SELECT cnpj_fundo_classe, tp_fundo_classe, denominacao_social, CAST(resgates AS DOUBLE) AS total_resgates,
  CAST(aportes AS DOUBLE) AS total_aportes, CAST(net AS DOUBLE) AS fluxo_liquido,
  ROW_NUMBER() OVER (ORDER BY net DESC, cnpj_fundo_classe, tp_fundo_classe, denominacao_social NULLS LAST) AS ranking
FROM (SELECT d.cnpj_fundo_classe, d.tp_fundo_classe, r.denominacao_social, SUM(d.resg_dia) AS resgates,
    SUM(d.captc_dia) AS aportes, SUM(d.net) AS net
  FROM recent d LEFT JOIN fx_registry r ON r.cnpj_fundo = d.cnpj_fundo_classe
  WHERE date_diff('day', d.dt_comptc, (SELECT MAX(dt_comptc) FROM fx_daily)) <= 7
  GROUP BY ALL HAVING SUM(d.net) <> 0)"""
    ),
    "flow_ranking_page_day": _page(f"dt_comptc = {LATEST_FLOW}", 0, 25),
    "flow_ranking_page_7_days": _page(f"dt_comptc >= {LATEST_FLOW} - INTERVAL 7 DAY", 1, 10),
    "flow_ranking_page_31_days": _page(f"dt_comptc >= {LATEST_FLOW} - INTERVAL 31 DAY", 2, 20),
    "flow_ranking_page_filtered": _page(
        f"dt_comptc >= {LATEST_FLOW} - INTERVAL 31 DAY AND tp_fundo_classe LIKE '%FIDC%' AND (lower(denominacao_social) LIKE '%customer#%')",
        0, 50, "denominacao_social DESC NULLS FIRST, ranking",
    ),
    "flow_ranking_after": sql(f"SELECT {FLOW} FROM flow WHERE ranking > 40 ORDER BY ranking LIMIT 25"),
    "flow_ranking_range": sql(f"SELECT {FLOW} FROM flow WHERE dt_comptc BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"),
    "flow_ranking_from": sql(f"SELECT {FLOW} FROM flow WHERE dt_comptc >= DATE '2024-01-20'"),
    "flow_ranking_until": sql(f"SELECT {FLOW} FROM flow WHERE dt_comptc <= DATE '2024-01-10'"),
    "available_dates": sql("SELECT DISTINCT dt_comptc FROM fx_daily ORDER BY 1 DESC"),
    "equity_exposure_latest": _exposure("dt_comptc = (SELECT MAX(dt_comptc) FROM fx_portfolio)"),
    "equity_exposure_range": _exposure("dt_comptc BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    "equity_positions": sql(
        f"""SELECT {EQUITY_COLUMNS} FROM fx_portfolio
WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF' AND tp_aplic = 'Ações' AND dt_comptc >= DATE '1996-01-01'"""
    ),
    "equity_positions_all": sql(f"SELECT {EQUITY_COLUMNS} FROM fx_portfolio WHERE tp_aplic = 'Ações'"),
    "portfolio_composition": sql("SELECT * FROM composition_served"),
    "portfolio_composition_some": sql(
        """SELECT * FROM composition_served WHERE cnpj_fundo_classe IN ('00000000000003', '00000000000007')
AND tp_fundo_classe IN ('CLASSES - FIF', 'FI')"""
    ),
    "portfolio_composition_by_list": sql(
        "SELECT * FROM composition_served WHERE cnpj_fundo_classe IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') FROM supplier WHERE s_acctbal > 4000)"
    ),
    "unified_positions": sql(
        "SELECT * REPLACE (CAST(vl_merc_pos_final AS DOUBLE) AS vl_merc_pos_final, CAST(qt_pos_final AS DOUBLE) AS qt_pos_final) FROM fx_unified"
    ),
    "quota_series": sql("SELECT * FROM series"),
    "quota_series_some": sql(
        "SELECT * FROM series WHERE cnpj_fundo_classe IN ('00000000000007', '00000000000021') AND tp_fundo_classe IN ('FI', 'CLASSES - FIF')"
    ),
    "fund_sheet_series": sql("SELECT * FROM series WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'"),
    "fund_sheet_chart": sql(
        "SELECT dt_comptc, vl_patrim_liq, vl_quota FROM series WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'"
    ),
    "fund_sheet_composition": sql(
        "SELECT * FROM composition_served WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'"
    ),
    "fund_sheet_header": sql(
        """SELECT * FROM composition_served WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'
ORDER BY dt_comptc DESC NULLS FIRST, ranking_posicao LIMIT 1"""
    ),
    "fund_sheet_months": sql(
        "SELECT DISTINCT dt_comptc FROM composition_served WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'"
    ),
    "fund_sheet_month_latest": sql(
        """SELECT * FROM one WHERE dt_comptc = (SELECT MAX(dt_comptc) FROM one)""",
        one="SELECT * FROM composition_served WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'",
    ),
    "fund_sheet_month_chosen": sql(
        "SELECT * FROM composition_served WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF' AND dt_comptc = DATE '1997-05-01'"
    ),
    "log_returns": _returns("cnpj_fundo_classe, tp_fundo_classe, id_subclasse", "dt_comptc"),
    "log_returns_by_fund": _returns("cnpj_fundo_classe", "dt_comptc, tp_fundo_classe, id_subclasse"),
    "vehicle_count": sql(
        "SELECT COUNT(*) AS numero_veiculos FROM (SELECT DISTINCT cnpj_fundo_classe, id_subclasse, tp_fundo_classe FROM fx_daily)"
    ),
    "manager_aum_active": sql("SELECT gestor, CAST(patrimonio AS DOUBLE) AS patrimonio_sobre_gestao FROM active WHERE patrimonio > 0"),
    "manager_aum_active_exact": sql(
        """SELECT gestor, CAST(SUM(vl_patrim_liq) AS DOUBLE) AS patrimonio_sobre_gestao FROM (
  SELECT i.cnpj_fundo_classe, i.vl_patrim_liq FROM fx_daily i QUALIFY ROW_NUMBER() OVER
    (PARTITION BY cnpj_fundo_classe, tp_fundo_classe, id_subclasse ORDER BY dt_comptc DESC) = 1) i
JOIN fx_registry r ON i.cnpj_fundo_classe = r.cnpj_fundo WHERE r.gestor IS NOT NULL AND r.situacao <> 'Cancelado'
GROUP BY gestor HAVING SUM(vl_patrim_liq) > 0"""
    ),
    "manager_aum_histogram": _bands("SELECT CAST(patrimonio AS DOUBLE) / 1000000 * 1000000 AS v FROM active WHERE patrimonio > 0", False),
    "manager_aum_histogram_closed": _bands("SELECT CAST(patrimonio AS DOUBLE) / 1000000 * 1000000000.0 AS v FROM active WHERE patrimonio > 0", True),
    "screen_funds": sql("SELECT * FROM facts WHERE lower(denominacao_social) LIKE '%er#0000%' AND patrimonio BETWEEN 5 AND 500"),
    "screen_funds_by_holders": sql("SELECT * FROM facts WHERE nr_cotistas = 2"),
    "screen_funds_capped": sql(
        """SELECT *, COUNT(*) OVER () AS total, COUNT(*) OVER () > 10 AS refinar_busca FROM facts WHERE nr_cotistas = 1"""
    ),
    "find_funds_by_id": sql(
        """SELECT DISTINCT concat('CNPJ: ', f) AS label, f AS value, 'CNPJ' AS tipo FROM (
  SELECT regexp_replace(cnpj_fundo, '^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$', '\\1.\\2.\\3/\\4-\\5') AS f FROM fx_registry
  WHERE cnpj_fundo LIKE '000000000001%')"""
    ),
    "find_funds_by_name": sql(
        """SELECT DISTINCT concat('Denominação: ', denominacao_social) AS label, denominacao_social AS value, 'Denominação Social' AS tipo
FROM fx_registry WHERE lower(denominacao_social) LIKE '%00 b%'"""
    ),
    "basket_holdings": sql(
        """SELECT b.id, b.name, b.cnpj AS cnpj_fundo_classe, f.tp_fundo_classe, f.id_subclasse, f.denominacao_social, f.patrimonio, f.dt_comptc
FROM fx_baskets b LEFT JOIN facts f ON b.cnpj = f.cnpj_fundo_classe"""
    ),
    "find_baskets": sql(
        """SELECT id, name, string_agg(cnpj, ',' ORDER BY cnpj) AS membros FROM fx_baskets WHERE lower(name) LIKE '%et 1%' GROUP BY 1, 2"""
    ),
    "create_basket": sql(
        """SELECT id, name, string_agg(cnpj, ',' ORDER BY cnpj) AS membros FROM fx_baskets GROUP BY 1, 2 UNION ALL SELECT -1, 'Nova', ''"""
    ),
}
for _indexed, _scanned in (
    ("find_funds_indexed", "find_funds_by_name"), ("find_funds_indexed_by_id", "find_funds_by_id"),
    ("screen_funds_indexed", "screen_funds"),
):
    ORACLE[_indexed] = ORACLE[_scanned]
