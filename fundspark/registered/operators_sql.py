"""DuckDB SQL of the registered single operators."""

from __future__ import annotations

from fundspark.registered.domain_sql import sql

KEYS = "cnpj_fundo_classe, dt_comptc, id_subclasse, tp_fundo_classe"
AMOUNTS = ["captc_dia", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total"]
LAST = "(SELECT MAX(dt_comptc) FROM fx_daily)"


def _daily(where: str) -> str:
    return sql(f"SELECT {KEYS} FROM fx_daily WHERE {where}")


def _doubles(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


FORMATTED = (
    "concat(k[1:2], '.', k[3:5], '.', k[6:8], '/', k[9:12], '-', k[13:14])"
)
TAX_IDS = """SELECT c_custkey, c_nationkey, c_acctbal, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS k FROM customer"""
CODES = """SELECT o_orderkey, o_orderdate, substr(o_orderpriority, 1, 1) AS p FROM orders"""


def _fixed_dates(early: str) -> str:
    return sql(
        f"""SELECT o_orderkey, CASE p WHEN '1' THEN CAST(o_orderdate AS DATE) WHEN '2' THEN DATE '1900-01-01'
  WHEN '4' THEN {early} END AS dt_reg FROM codes""",
        codes=CODES,
    )


def _upsert(others: str) -> str:
    """Target until the 20th, source from the 15th; ``others`` is each other column's rule."""
    t, s = "(SELECT * FROM fx_daily WHERE dt_comptc <= DATE '2024-01-20')", (
        "(SELECT * REPLACE (CASE WHEN resg_dia IS NOT NULL THEN vl_quota + 1 END AS vl_quota)"
        " FROM fx_daily WHERE dt_comptc >= DATE '2024-01-15')"
    )
    join = " AND ".join(f"t.{k} = s.{k}" for k in KEYS.split(", "))
    keys = ", ".join(f"COALESCE(s.{k}, t.{k}) AS {k}" for k in KEYS.split(", "))
    hit = "s.cnpj_fundo_classe IS NOT NULL"
    rest = ", ".join(
        f"CAST(CASE WHEN {hit} THEN s.{c} ELSE t.{c} END AS DOUBLE) AS {c}" for c in AMOUNTS
    )
    return sql(f"SELECT {keys}, {others}, {rest} FROM {t} t FULL JOIN {s} s ON {join}")


EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"

ORACLE: dict[str, str] = {
    "clean_tax_ids": sql(
        """SELECT c_custkey AS id, k AS cnpj_fundo, CASE WHEN c_acctbal >= 0 THEN k END AS cnpj_admin,
  concat('123456', CAST(c_nationkey AS VARCHAR), '01') AS cpf_cnpj_gestor FROM ids""",
        ids=TAX_IDS,
    ),
    "strip_tax_ids": sql(
        f"""SELECT c_custkey AS id, replace(replace(replace({FORMATTED}, '.', ''), '/', ''), '-', '') AS cnpj_fundo,
  CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS cnpj_admin,
  concat('123456', CAST(c_nationkey AS VARCHAR), '01') AS cpf_cnpj_gestor FROM ids""",
        ids=TAX_IDS,
    ),
    "cut_text": "SELECT c_custkey, left(c_name, 12) AS c_name, c_mktsegment FROM customer",
    "clean_chars": sql(
        """SELECT o_orderkey, CASE WHEN p IN ('1', '2') THEN 'S' END AS entid_invest,
  CASE p WHEN '1' THEN 'S' WHEN '2' THEN 'SI' END AS pf_pj_gestor FROM codes""",
        codes=CODES,
    ),
    "fix_invalid_dates": _fixed_dates("DATE '0202-01-01'"),
    "fix_invalid_dates_in_range": _fixed_dates("DATE '1900-01-01'"),
    "layout_drift": """SELECT CAST(s_suppkey AS VARCHAR) AS cnpj_fundo_classe, 'FI' AS tp_fundo_classe,
  s_name AS denom_social, 'NA' AS id_subclasse FROM supplier""",
    "fill_missing_key": sql("SELECT cnpj_fundo_classe, dt_comptc, nr_cotst, id_subclasse FROM fx_daily"),
    "conform": """SELECT l_orderkey AS id_registro_fundo, l_linenumber AS linha,
  CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(19,2)) AS DOUBLE) END AS vl_total,
  CASE WHEN l_linestatus <> 'O' THEN CAST(CAST(l_extendedprice AS DECIMAL(19,2)) AS DOUBLE) END AS vl_quota,
  CAST(NULL AS VARCHAR) AS diretor FROM lineitem""",
    "cast_losses": """SELECT CAST(0 AS BIGINT) AS id_registro_fundo, CAST(0 AS BIGINT) AS linha,
  COUNT(*) FILTER (l_returnflag = 'R') AS vl_total, COUNT(*) FILTER (l_linestatus = 'O') AS vl_quota FROM lineitem""",
    "serving_shape": sql(
        f"""SELECT {KEYS}, COALESCE(CAST(captc_dia AS DOUBLE), 0) AS captc_dia, COALESCE(CAST(resg_dia AS DOUBLE), 0) AS resg_dia,
  NULLIF(CAST(vl_quota AS DOUBLE), 0) AS vl_quota FROM fx_daily"""
    ),
    "finite_or_null": """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem""",
    "lineage": "SELECT 'orders.parquet' AS arquivo_origem, COUNT(*) AS linhas, COUNT(*) AS com_data FROM orders",
    "in_millions": "SELECT c_custkey, c_acctbal / 1000000 AS milhoes FROM customer",
    "percent_change": sql(
        f"""SELECT {KEYS}, CASE WHEN vl_quota > 0 THEN (CAST(vl_total AS DOUBLE) - CAST(vl_quota AS DOUBLE))
  / CAST(vl_quota AS DOUBLE) * 100 END AS variacao_percentual FROM fx_daily"""
    ),
    "round_half_even": """SELECT l_orderkey, l_linenumber,
  (CASE WHEN y - f > 0.5 OR (y - f = 0.5 AND f % 2 <> 0) THEN f + 1 ELSE f END) / 100 AS valor
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 8 * 100 AS y, floor(l_extendedprice / 8 * 100) AS f FROM lineitem)""",
    "join_text": sql("SELECT id_registro_fundo, concat(COALESCE(cpf_cnpj_gestor, ''), gestor) AS chave FROM fx_registry"),
    "parse_or_default": """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN NULL ELSE o_custkey END AS fator FROM orders""",
    "compact_dates": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS data FROM orders",
    "month_tokens": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS mes FROM orders""",
    "day_buckets": "SELECT strftime(ts, '%Y.%m.%d') AS dia, COUNT(*) AS linhas FROM events GROUP BY 1",
    "date_range_both": _daily("dt_comptc BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"),
    "date_range_from": _daily("dt_comptc >= DATE '2024-01-25'"),
    "date_range_until": _daily("dt_comptc <= DATE '2024-01-03'"),
    "date_range_open": _daily("TRUE"),
    "latest_date_rows": _daily(f"dt_comptc = {LAST}"),
    "trailing_day": _daily(f"dt_comptc = {LAST}"),
    "trailing_7_days": _daily(f"dt_comptc >= {LAST} - INTERVAL 7 DAY"),
    "trailing_31_days": _daily(f"dt_comptc >= {LAST} - INTERVAL 31 DAY"),
    "trailing_unknown": _daily(f"dt_comptc = {LAST}"),
    "class_funds": _daily("tp_fundo_classe LIKE '%CLASSES%'"),
    "positive_assets": _daily("vl_patrim_liq IS NOT NULL AND vl_patrim_liq > 0"),
    "any_flow": _daily("resg_dia IS NOT NULL OR captc_dia IS NOT NULL"),
    "in_list": _daily("tp_fundo_classe IN ('FI', 'CLASSES - FIF')"),
    "in_empty_list": _daily("TRUE"),
    "one_vehicle": _daily("cnpj_fundo_classe = '00000000000003' AND tp_fundo_classe = 'CLASSES - FIF'"),
    "in_long_list": _daily("cnpj_fundo_classe IN (SELECT cnpj_fundo FROM fx_registry)"),
    "named_managers": sql("SELECT id_registro_fundo FROM fx_registry WHERE cpf_cnpj_gestor IS NOT NULL AND gestor <> ''"),
    "not_cancelled": sql("SELECT id_registro_fundo FROM fx_registry WHERE cpf_cnpj_gestor IS NOT NULL AND situacao <> 'Cancelado'"),
    "read_with_predicate": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "missing_in_registry": _daily("cnpj_fundo_classe NOT IN (SELECT cnpj_fundo FROM fx_registry)"),
    "with_parent": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "latest_per_vehicle": sql("SELECT cnpj_fundo_classe, tp_fundo_classe, MAX(dt_comptc) AS ultima_data FROM fx_daily GROUP BY 1, 2"),
    "at_latest_date": sql(
        f"""SELECT {KEYS}, CAST(vl_total AS DOUBLE) AS vl_total, nr_cotst FROM fx_daily
QUALIFY dt_comptc = MAX(dt_comptc) OVER (PARTITION BY cnpj_fundo_classe, tp_fundo_classe)"""
    ),
    "flow_sums": sql(
        """SELECT cnpj_fundo_classe, tp_fundo_classe, dt_comptc, CAST(vl_total AS DOUBLE) AS vl_total,
  CAST(SUM(resg_dia) AS DOUBLE) AS total_resgates, CAST(SUM(captc_dia) AS DOUBLE) AS total_aportes,
  CAST(SUM(captc_dia - resg_dia) AS DOUBLE) AS fluxo_liquido
FROM fx_daily GROUP BY cnpj_fundo_classe, tp_fundo_classe, dt_comptc, fx_daily.vl_total"""
    ),
    "latest_date": sql("SELECT MAX(dt_comptc) AS ultima_data FROM fx_daily"),
    "count_with_filter": sql(f"SELECT COUNT(*) AS total FROM fx_daily WHERE dt_comptc >= {LAST} - INTERVAL 7 DAY"),
    "distinct_funds": sql("SELECT DISTINCT cnpj_fundo_classe FROM fx_daily"),
    "union_by_name": """SELECT c_custkey AS id, c_name AS nome, CAST(NULL AS DOUBLE) AS saldo FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
    "dedup_keep_last": f"{EVENTS} QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "dedup_keep_first": f"{EVENTS} QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "duplicate_report": """SELECT * FROM (SELECT event_id, user_id, event_type, value, props,
  COUNT(*) OVER (PARTITION BY user_id, event_type) AS copies FROM events) WHERE copies > 1""",
    "dedup_counters": """SELECT COUNT(*) AS rows_before, COUNT(DISTINCT (user_id, event_type)) AS rows_after,
  COUNT(*) - COUNT(DISTINCT (user_id, event_type)) AS rows_dropped FROM events""",
    "merge_upsert": _upsert(
        "CASE WHEN s.cnpj_fundo_classe IS NOT NULL THEN s.nr_cotst ELSE t.nr_cotst END AS nr_cotst"
    ),
    "merge_upsert_some_columns": _upsert(
        "CASE WHEN t.cnpj_fundo_classe IS NOT NULL THEN t.nr_cotst ELSE -1 END AS nr_cotst"
    ),
    "global_rank_placed": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  ROW_NUMBER() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ranking FROM lineitem""",
    "rank_in_group_stitched": """SELECT event_id, user_id, event_type, value,
  ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC NULLS FIRST, event_id) AS posicao FROM events""",
    "lag_in_group_stitched": """SELECT event_id, user_id, event_type, value, LAG(value) OVER w AS valor_anterior,
  LAG(event_id) OVER w AS evento_anterior FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
    "page_of_orders": """SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) AS total, 3 AS page, 30 AS page_size,
  CAST(ceil((SELECT COUNT(*) FROM orders) / 30) AS BIGINT) AS total_pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 90""",
    "deep_page_of_lines": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, (SELECT COUNT(*) FROM lineitem) AS total,
  190 AS page, 30 AS page_size, CAST(ceil((SELECT COUNT(*) FROM lineitem) / 30) AS BIGINT) AS total_pages FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate LIMIT 30 OFFSET 5700""",
    "extract_links": """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) AS BIGINT) AS ordem,
  concat('https://example.org/dados', link) AS url
FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages))
WHERE ends_with(link, 'n')""",
}
