"""DuckDB SQL of the registered loads: what the loaded tables must contain."""

from __future__ import annotations

from fundspark.registered.domain_sql import FX, sql
from fundspark.registered.operators_sql import ORACLE as OPERATORS
from fundspark.registered.reports_sql import FLOW
from fundspark.registered.reports_sql import ORACLE as REPORTS

KEYS = "cnpj_fundo_classe, dt_comptc, id_subclasse, tp_fundo_classe"
AMOUNTS = ["captc_dia", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total"]
DAILY = f"{KEYS}, nr_cotst, " + ", ".join(f"CAST({a} AS DOUBLE) AS {a}" for a in AMOUNTS)
JANUARY = f"SELECT {DAILY} FROM fx_daily"

QUOTES = """SELECT *, substr(o_orderpriority, 1, 1) AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS opening,
  CASE WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) = '2' THEN 'curta'
    WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) = '1' THEN 'ilegivel' ELSE 'valida' END AS state FROM orders"""
MOVES = """SELECT *, CASE WHEN opening > 0 THEN (CAST(cents + o_custkey AS DOUBLE) / 100 - CAST(opening AS DOUBLE) / 100)
  / (CAST(opening AS DOUBLE) / 100) * 100 * 100 END AS y FROM quotes WHERE state = 'valida'"""
MOVE = "(CASE WHEN y - floor(y) > 0.5 OR (y - floor(y) = 0.5 AND floor(y) % 2 <> 0) THEN floor(y) + 1 ELSE floor(y) END) / 100"
SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'S' WHEN 'MACHINERY' THEN 'S' END"
ID = "lpad(CAST(c_custkey AS VARCHAR), 14, '0')"

# The further columns of the registration file.
_TEXTS = (
    "admin auditor classe classe_anbima condom controlador custodiante diretor gestor inf_taxa_adm inf_taxa_perfm"
    " publico_alvo rentab_fundo sit tp_fundo"
).split()
_IDS = ["cnpj_auditor", "cnpj_controlador", "cnpj_custodiante"]
_CODES = ["fundo_cotas", "fundo_exclusivo", "invest_cempr_exter"]
_DAYS = (
    "dt_cancel dt_const dt_fim_exerc dt_ini_ativ dt_ini_classe dt_ini_exerc dt_ini_sit dt_patrim_liq".split()
)
OTHERS = ", ".join(
    [f"concat('{c} ', c_mktsegment) AS {c}" for c in _TEXTS]
    + [f"lpad(CAST(c_nationkey AS VARCHAR), 14, '0') AS {c}" for c in _IDS]
    + [f"CASE WHEN c_mktsegment = 'BUILDING' THEN 'N' END AS {c}" for c in _CODES]
    + [f"CASE WHEN c_acctbal > 3000 THEN DATE '2019-12-31' WHEN c_acctbal > 500 THEN DATE '1900-01-01' END AS {c}" for c in _DAYS]
    + ["CAST(2.25 AS DOUBLE) AS taxa_perfm", "CAST(c_custkey AS DOUBLE) AS cd_cvm"]
)
NOTHING = ", ".join(["NULL"] * (len(_TEXTS) + len(_IDS) + len(_CODES) + len(_DAYS) + 2))

ORACLE: dict[str, str] = {
    "load_daily": sql(JANUARY),
    "load_daily_all_months": sql(
        f"""{JANUARY} UNION ALL SELECT cnpj_fundo_classe, CAST(dt_comptc - INTERVAL 31 DAY AS DATE), id_subclasse, tp_fundo_classe,
  nr_cotst, {", ".join(f"CAST({a} AS DOUBLE)" for a in AMOUNTS)} FROM fx_daily WHERE id_subclasse = 'NA'"""
    ),
    "load_daily_table": sql(JANUARY),
    "ingest_daily": sql(JANUARY),
    "stored_trailing_7_days": OPERATORS["trailing_7_days"],
    "upsert_daily_table": OPERATORS["merge_upsert"],
    "upsert_returns": REPORTS["log_returns"],
    "observed_counters": "SELECT COUNT(*) AS rows_before, COUNT(DISTINCT (user_id, event_type)) AS rows_after FROM events",
    "load_registration": f"""SELECT {ID} AS cnpj_fundo, concat(c_name, ' é') AS denom_social,
  lpad(CAST(c_nationkey AS VARCHAR), 14, '0') AS cnpj_admin, concat('123456789', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS cpf_cnpj_gestor,
  {SEGMENT} AS entid_invest, 'PJ' AS pf_pj_gestor,
  CASE WHEN c_acctbal > 5000 THEN DATE '2020-01-02' WHEN c_acctbal > 1000 THEN DATE '1900-01-01' END AS dt_reg,
  'LONGO PRAZO' AS trib_lprazo, CAST(1.5 AS DOUBLE) AS taxa_adm, CAST(CAST(c_acctbal AS DECIMAL(24,2)) AS DOUBLE) AS vl_patrim_liq, {OTHERS}
FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT {ID}, concat(c_name, ' é novo'), NULL, NULL, NULL, NULL, NULL, 'LON', NULL, NULL, {NOTHING} FROM customer WHERE c_acctbal < 0""",
    "load_registry_funds": sql(
        """SELECT id_registro_fundo, cnpj_fundo, denominacao_social, situacao, cpf_cnpj_gestor, gestor,
  DATE '2021-03-04' AS data_registro FROM fx_registry"""
    ),
    "load_registry_classes": f"""SELECT c_custkey + 500000000 AS id_registro_classe, c_custkey AS id_registro_fundo, {ID} AS cnpj_classe,
  c_name AS denominacao_social, 'CDI' AS identificador_desempenho, 'S' AS permitido_aplicacao_cem_por_cento_exterior,
  CAST(CAST(c_acctbal AS DECIMAL(24,2)) AS DOUBLE) AS patrimonio_liquido FROM customer WHERE c_acctbal >= 0""",
    "load_registry_subclasses": """SELECT concat('S', CAST(o_orderkey AS VARCHAR)) AS id_subclasse, o_custkey + 500000000 AS id_registro_classe,
  CAST(o_orderkey AS DOUBLE) AS codigo_cvm, CAST(o_orderdate AS DATE) AS data_inicio, 'Subclasse' AS denominacao_social, 'N' AS exclusivo
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0""",
    "load_portfolio": sql(
        """SELECT * REPLACE (CAST(vl_merc_pos_final AS DOUBLE) AS vl_merc_pos_final, CAST(qt_pos_final AS DOUBLE) AS qt_pos_final,
  CASE WHEN origem_tabela IN ('FUNDOS', 'DEPOSITO_PRAZO_IF') THEN lpad(codigo_ativo, 14, '0') ELSE codigo_ativo END AS codigo_ativo)
FROM fx_unified"""
    ),
    "stored_equity_exposure_latest": REPORTS["equity_exposure_latest"],
    "stored_equity_exposure_range": REPORTS["equity_exposure_range"],
    "stored_equity_positions": sql(
        """SELECT origem_tabela, dt_comptc, tp_ativo, CAST(vl_merc_pos_final AS DOUBLE) AS vl_merc_pos_final, CAST(qt_pos_final AS DOUBLE) AS qt_pos_final
FROM fx_unified WHERE cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF' AND tp_aplic = 'Ações' AND dt_comptc >= DATE '1996-01-01'"""
    ),
    "stored_portfolio_composition": sql(
        "SELECT * FROM composition_served",
        landed_rows=FX["fx_unified"],
        fx_unified="""SELECT * REPLACE (CASE WHEN origem_tabela IN ('FUNDOS', 'DEPOSITO_PRAZO_IF') THEN lpad(codigo_ativo, 14, '0')
  ELSE codigo_ativo END AS codigo_ativo) FROM landed_rows""",
    ),
    "block_views": sql(
        """SELECT concat('composicao_carteira_', lower(origem_tabela)) AS tabela, COUNT(*) AS linhas,
  CAST(SUM(vl_merc_pos_final) AS DOUBLE) AS valor FROM fx_unified GROUP BY 1"""
    ),
    "load_quotes": sql(
        f"""SELECT CAST(o_orderdate AS DATE) AS data_pregao, concat('TK', CAST(o_orderkey AS VARCHAR)) AS codigo_negociacao,
  '02' AS codigo_bdi, '010' AS tipo_mercado, 'ON' AS especificacao_papel, '0' AS indicador_correcao,
  CAST(cents AS DOUBLE) / 100 AS preco_minimo, CAST(cents AS DOUBLE) / 100 AS preco_medio, CAST(0 AS DOUBLE) AS preco_melhor_oferta_venda,
  CAST(0 AS DOUBLE) AS preco_exercicio, CAST(0 AS DOUBLE) AS preco_exercicio_pontos,
  'AÇÕES SA' AS nome_empresa, 'R$' AS moeda_referencia, CAST(0 AS BIGINT) AS prazo_dias_mercado,
  CAST(opening AS DOUBLE) / 100 AS preco_abertura, CAST(cents AS DOUBLE) / 100 AS preco_maximo,
  CAST(cents + o_custkey AS DOUBLE) / 100 AS preco_ultimo, CAST(NULL AS DOUBLE) AS preco_melhor_oferta_compra,
  o_custkey % 100000 AS numero_negocios, CASE WHEN p = '3' THEN 0 ELSE o_custkey END AS quantidade_titulos, cents AS volume_total,
  CASE WHEN o_orderstatus <> 'O' THEN DATE '2030-12-31' END AS data_vencimento,
  CAST(CASE WHEN p = '2' THEN 1 ELSE 1000 END AS BIGINT) AS fator_cotacao, 'BRTKACNOR000' AS codigo_isin, '123' AS distribuicao,
  {MOVE} AS variacao_percentual FROM moves""",
        quotes=QUOTES, moves=MOVES,
    ),
    "load_quotes_zero_as_null": sql(
        f"""SELECT concat('TK', CAST(o_orderkey AS VARCHAR)) AS codigo_negociacao, 'AÇÕES SA' AS nome_empresa, NULLIF(CAST(opening AS DOUBLE) / 100, 0) AS preco_abertura,
  {MOVE} AS variacao_percentual FROM moves""",
        quotes=QUOTES, moves=MOVES,
    ),
    "classify_quote_lines": sql(
        """SELECT situacao_linha, CAST(SUM(n) AS BIGINT) AS linhas FROM (
  SELECT state AS situacao_linha, COUNT(*) AS n FROM quotes GROUP BY 1
  UNION ALL SELECT 'cabecalho', 1 UNION ALL SELECT 'ilegivel', 1 UNION ALL SELECT 'vazia', 1) GROUP BY 1""",
        quotes=QUOTES,
    ),
    "rejected_quote_lines": sql(
        """SELECT state AS situacao_linha, concat('TK', CAST(o_orderkey AS VARCHAR)) AS codigo_negociacao FROM quotes WHERE state <> 'valida'
UNION ALL SELECT 'ilegivel', '025'""",
        quotes=QUOTES,
    ),
    "skip_long_lines": """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_acctbal > 6000 THEN 'Ação; "X"' ELSE s_name END AS nome,
  CASE WHEN s_acctbal > 6000 THEN NULL ELSE '1' END AS saldo FROM supplier WHERE s_acctbal > 6000 OR s_acctbal <= 2000""",
    "report_long_lines": "SELECT CAST(s_suppkey AS VARCHAR) AS primeiro_campo FROM supplier WHERE s_acctbal <= 6000 AND s_acctbal > 2000",
    "silver_manager_ranking": REPORTS["manager_aum_ranking"],
    "silver_flow_ranking": sql(f"SELECT {FLOW} FROM flow"),
    "silver_dates": REPORTS["available_dates"],
    "unzip_landing": """SELECT concat('clientes_', CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS VARCHAR), '.zip') AS archive, 'clientes.csv' AS member,
  row_number() OVER (PARTITION BY floor(c_custkey / 500) ORDER BY c_custkey) - 1 AS line_no,
  concat(CAST(c_custkey AS VARCHAR), ';', c_name, ' é') AS line FROM customer""",
    "log_stream": "SELECT concat_ws(' ', CAST(event_id AS VARCHAR), event_type, props) AS mensagem FROM events",
}
_READ = "(SELECT 2 * COUNT(*) FROM fx_daily) + (SELECT COUNT(*) FROM fx_daily WHERE id_subclasse = 'NA')"
_LEFT = "(SELECT COUNT(*) FROM fx_daily) + (SELECT COUNT(*) FROM fx_daily WHERE id_subclasse = 'NA')"
ORACLE["load_daily_counters"] = sql(f"SELECT {_READ} AS lidas, {_LEFT} AS gravadas")
ORACLE["ingest_daily_counters"] = ORACLE["load_daily_counters"]
ORACLE["load_losses"] = sql(
    """SELECT 0::BIGINT AS cnpj_fundo_classe, 0::BIGINT AS tp_fundo_classe, 0::BIGINT AS id_subclasse, COUNT(*) FILTER (nr_cotst = 3) AS dt_comptc,
  0::BIGINT AS captc_dia, 0::BIGINT AS nr_cotst, COUNT(resg_dia) AS resg_dia, 0::BIGINT AS vl_patrim_liq, 0::BIGINT AS vl_quota,
  COUNT(*) FILTER (nr_cotst = 2) AS vl_total FROM fx_daily"""
)
_RANGES = {"dia": "dt_comptc = DATE '2024-01-05'", "semana": "dt_comptc BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", "tudo": "true", "nada": "false"}
ORACLE["distinct_funds_sketch"] = sql(" UNION ALL ".join(
    f"SELECT '{name}' AS periodo, COUNT(*) AS linhas, COUNT(DISTINCT (cnpj_fundo_classe, tp_fundo_classe)) AS exatos, true AS dentro_do_erro FROM fx_daily WHERE {where}"
    for name, where in _RANGES.items()
))
ORACLE["upsert_registry_bucketed"] = sql(
    """SELECT * REPLACE (CASE WHEN id_registro_fundo % 40 = 0 THEN concat(denominacao_social, ' Z') ELSE denominacao_social END AS denominacao_social) FROM fx_registry
UNION ALL SELECT * REPLACE (id_registro_fundo + 900000000 AS id_registro_fundo) FROM fx_registry WHERE id_registro_fundo % 40 = 0"""
)
ORACLE["bucketed_flow_join"] = REPORTS["flow_ranking"]
ORACLE["silver_refresh_incremental"] = ORACLE["silver_flow_ranking"]
_MONTHS = "(SELECT CAST(dt_comptc + to_months(CAST(nr_cotst % 3 AS INTEGER)) AS DATE) AS d FROM fx_daily)"
ORACLE["stored_latest_date"] = sql(f"SELECT MAX(d) AS ultima_data FROM {_MONTHS}")
ORACLE["stored_month_ranges"] = sql(
    f"""SELECT CAST(strftime(d, '%Y%m') AS INTEGER) AS ym, MIN(d) AS primeira_data, MAX(d) AS ultima_data, COUNT(*) AS linhas
FROM {_MONTHS} GROUP BY 1"""
)
ORACLE["ingest_daily_both_layouts"] = ORACLE["load_daily_all_months"]
ORACLE["unzip_and_load_daily"] = ORACLE["load_daily_all_months"]
ORACLE["log_tail_appended"] = ORACLE["log_stream"]
for _page in ("flow_ranking_page_day", "flow_ranking_page_31_days"):
    ORACLE[f"stored_{_page}"] = REPORTS[_page]
