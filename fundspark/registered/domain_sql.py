"""DuckDB SQL of the domain tables over the generic test tables (see FIXTURES.md).

A query's SQL is ``WITH <the tables it uses>, ... SELECT``.
"""

from __future__ import annotations

import re

FX = {
    "fx_daily": """
SELECT lpad(CAST(user_id AS VARCHAR), 14, '0') AS cnpj_fundo_classe, CAST(ts AS DATE) AS dt_comptc,
  CASE WHEN user_id % 7 = 0 THEN concat('S', CAST(event_id % 2 AS VARCHAR)) ELSE 'NA' END AS id_subclasse,
  CASE user_id % 3 WHEN 0 THEN 'CLASSES - FIF' WHEN 1 THEN 'FI' ELSE 'CLASSES - FIDC' END AS tp_fundo_classe,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(17,2)) END) AS DECIMAL(17,2)) AS captc_dia,
  CAST(COUNT(*) AS INT) AS nr_cotst,
  CAST(SUM(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(17,2)) END) AS DECIMAL(17,2)) AS resg_dia,
  CAST(SUM(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(17,2)) END) AS DECIMAL(17,2)) AS vl_patrim_liq,
  CAST(COALESCE(SUM(CASE WHEN event_type IN ('view','click') THEN CAST(value AS DECIMAL(17,2)) END), 0) AS DECIMAL(27,12)) AS vl_quota,
  CAST(SUM(CAST(value AS DECIMAL(17,2))) AS DECIMAL(17,2)) AS vl_total
FROM events GROUP BY 1, 2, 3, 4""",
    "fx_registry": """
SELECT c_custkey AS id_registro_fundo,
  lpad(CAST(CASE WHEN c_acctbal < 0 THEN c_custkey + 500000000 ELSE c_custkey END AS VARCHAR), 14, '0') AS cnpj_fundo, c_name AS denominacao_social,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Cancelado' ELSE 'Em Funcionamento Normal' END AS situacao,
  CASE WHEN c_nationkey % 8 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS VARCHAR), 11, '0') END AS cpf_cnpj_gestor, n_name AS gestor
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT c_custkey + 100000000, lpad(CAST(c_custkey AS VARCHAR), 14, '0'), concat(c_name, ' B'), 'Em Funcionamento Normal',
  lpad(CAST(c_nationkey AS VARCHAR), 11, '0'), n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500""",
    "fx_portfolio": """
SELECT CAST(l_orderkey % 8 + 1 AS INT) AS tipo, lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS cnpj_fundo_classe,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS dt_comptc,
  CASE l_suppkey % 3 WHEN 0 THEN 'CLASSES - FIF' WHEN 1 THEN 'FI' ELSE 'CLASSES - FIDC' END AS tp_fundo_classe,
  CASE WHEN l_returnflag = 'A' THEN 'Ações' ELSE 'Debêntures' END AS tp_aplic, l_linestatus AS tp_ativo,
  concat('A', CAST(l_partkey % 20 AS VARCHAR)) AS codigo_ativo,
  CAST(SUM(CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(19,2)) END) AS DECIMAL(19,2)) AS vl_merc_pos_final,
  CAST(SUM(CAST(l_quantity AS DECIMAL(21,6))) AS DECIMAL(21,6)) AS qt_pos_final
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "fx_unified": """
SELECT cnpj_fundo_classe, dt_comptc, tp_fundo_classe, tp_aplic, tp_ativo,
  concat('Fundo ', cnpj_fundo_classe) AS denominacao_social, codigo_ativo,
  CASE WHEN tipo IN (1, 4) THEN concat('BR', codigo_ativo) END AS cd_isin, vl_merc_pos_final, qt_pos_final,
  CASE tipo WHEN 1 THEN 'TITULO_PUBLICO_SELIC' WHEN 2 THEN 'FUNDOS' WHEN 3 THEN 'SWAPS' WHEN 4 THEN 'DEMAIS_CODIFICADOS'
    WHEN 5 THEN 'DEPOSITO_PRAZO_IF' WHEN 6 THEN 'TITULO_PRIVADO' WHEN 7 THEN 'INVESTIMENTO_EXTERIOR' ELSE 'NAO_CODIFICADOS' END AS origem_tabela
FROM fx_portfolio""",
    "fx_baskets": """
SELECT CAST(floor(c_custkey / 25) AS BIGINT) AS id, concat('Basket ', CAST(CAST(floor(c_custkey / 25) AS BIGINT) AS VARCHAR)) AS name,
  lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj
FROM customer""",
    # Manager ranking, flow ranking and composition, shared by several queries.
    "aum": """
SELECT r.cpf_cnpj_gestor, r.gestor, COUNT(DISTINCT (v.cnpj_fundo_classe, v.tp_fundo_classe)) AS numero_veiculos,
  SUM(v.vl_patrim_liq) AS patrimonio
FROM (SELECT * FROM fx_daily WHERE vl_patrim_liq > 0 AND contains(tp_fundo_classe, 'CLASSES')
      QUALIFY dt_comptc = MAX(dt_comptc) OVER (PARTITION BY cnpj_fundo_classe, tp_fundo_classe)) v,
  (SELECT * FROM fx_registry WHERE cpf_cnpj_gestor IS NOT NULL AND gestor <> '') r
WHERE r.cnpj_fundo = v.cnpj_fundo_classe GROUP BY ALL""",
    "recent": """
SELECT *, captc_dia - resg_dia AS net FROM fx_daily
WHERE date_diff('day', dt_comptc, (SELECT MAX(dt_comptc) FROM fx_daily)) <= 31 AND COALESCE(resg_dia, captc_dia) IS NOT NULL""",
    "flow_rows": """
SELECT d.cnpj_fundo_classe, d.tp_fundo_classe, d.dt_comptc, r.denominacao_social, d.vl_total,
  SUM(d.resg_dia) AS total_resgates, SUM(d.captc_dia) AS total_aportes, SUM(d.net) AS fluxo_liquido
FROM recent d LEFT JOIN fx_registry r ON r.cnpj_fundo = d.cnpj_fundo_classe
GROUP BY ALL HAVING SUM(d.net) <> 0""",
    "flow_units": """
SELECT *, CAST(CAST(fluxo_liquido AS DECIMAL(20,2)) * 100 AS HUGEINT) AS n, CAST(vl_total * 100 AS HUGEINT) AS d FROM flow_rows""",
    "flow_percent": """
SELECT *, CASE WHEN d > 0 THEN sign(n) * ((2 * abs(n) * 10000 + d) // (2 * d)) ELSE 0 END AS hundredths FROM flow_units""",
    "flow": """
SELECT cnpj_fundo_classe, tp_fundo_classe, dt_comptc, denominacao_social,
  COALESCE(CAST(vl_total AS DOUBLE), 0) AS vl_total, COALESCE(CAST(total_resgates AS DOUBLE), 0) AS total_resgates,
  COALESCE(CAST(total_aportes AS DOUBLE), 0) AS total_aportes, COALESCE(CAST(fluxo_liquido AS DOUBLE), 0) AS fluxo_liquido,
  CASE WHEN abs(hundredths) < 10000000000 THEN CAST(hundredths AS DOUBLE) / 100 ELSE 0.0 END AS percentual_fluxo_liquido,
  ROW_NUMBER() OVER (ORDER BY flow_percent.fluxo_liquido DESC, cnpj_fundo_classe, tp_fundo_classe, dt_comptc,
    denominacao_social NULLS LAST, flow_percent.vl_total NULLS LAST) AS ranking
FROM flow_percent""",
    "composition": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY cnpj_fundo_classe, tp_fundo_classe, dt_comptc
    ORDER BY vl_merc_pos_final DESC NULLS FIRST, origem_tabela, codigo_ativo NULLS LAST, tp_aplic NULLS LAST, tp_ativo NULLS LAST) AS ranking_posicao,
  CASE WHEN anterior > 0 THEN (CAST(vl_merc_pos_final AS DOUBLE) - CAST(anterior AS DOUBLE)) / CAST(anterior AS DOUBLE) * 100 END AS variacao
FROM (SELECT *, LAG(vl_merc_pos_final) OVER w AS anterior, LAG(dt_comptc) OVER w AS dt_comptc_anterior FROM fx_unified
  WINDOW w AS (PARTITION BY cnpj_fundo_classe, tp_fundo_classe, codigo_ativo, origem_tabela
    ORDER BY dt_comptc ASC NULLS LAST, tp_aplic NULLS LAST, tp_ativo NULLS LAST))""",
    "composition_served": """
SELECT cnpj_fundo_classe, dt_comptc, tp_fundo_classe, tp_aplic, tp_ativo, denominacao_social, codigo_ativo, cd_isin,
  COALESCE(CAST(vl_merc_pos_final AS DOUBLE), 0) AS vl_merc_pos_final, COALESCE(CAST(qt_pos_final AS DOUBLE), 0) AS qt_pos_final,
  origem_tabela, NULLIF(CAST(anterior AS DOUBLE), 0) AS vl_merc_pos_final_anterior, dt_comptc_anterior,
  NULLIF(variacao, 0) AS variacao_percentual, ranking_posicao
FROM composition""",
    "series": """
SELECT i.cnpj_fundo_classe, i.tp_fundo_classe, i.dt_comptc, i.id_subclasse, COALESCE(CAST(i.captc_dia AS DOUBLE), 0) AS captc_dia,
  i.nr_cotst, COALESCE(CAST(i.resg_dia AS DOUBLE), 0) AS resg_dia, COALESCE(CAST(i.vl_patrim_liq AS DOUBLE), 0) AS vl_patrim_liq,
  COALESCE(CAST(i.vl_quota AS DOUBLE), 0) AS vl_quota, COALESCE(CAST(i.vl_total AS DOUBLE), 0) AS vl_total, r.denominacao_social
FROM fx_daily i LEFT JOIN fx_registry r ON i.cnpj_fundo_classe = r.cnpj_fundo""",
    "series_ends": """
SELECT cnpj_fundo_classe, dt_comptc FROM fx_daily
QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj_fundo_classe, tp_fundo_classe, id_subclasse ORDER BY dt_comptc DESC) = 1""",
    "active": """
SELECT r.gestor, SUM(d.vl_patrim_liq) AS patrimonio
FROM series_ends JOIN fx_daily d USING (cnpj_fundo_classe, dt_comptc)
JOIN (SELECT cnpj_fundo, gestor FROM fx_registry WHERE gestor IS NOT NULL AND situacao <> 'Cancelado') r
  ON r.cnpj_fundo = cnpj_fundo_classe
GROUP BY r.gestor""",
    "facts": """
SELECT i.cnpj_fundo_classe, i.tp_fundo_classe, i.id_subclasse, i.dt_comptc, r.denominacao_social,
  CAST(i.vl_patrim_liq AS DOUBLE) AS patrimonio, i.nr_cotst AS nr_cotistas
FROM fx_daily i JOIN (SELECT cnpj_fundo_classe, tp_fundo_classe, MAX(dt_comptc) AS ultima FROM fx_daily GROUP BY 1, 2) u
  ON i.cnpj_fundo_classe = u.cnpj_fundo_classe AND i.tp_fundo_classe = u.tp_fundo_classe AND i.dt_comptc = u.ultima
JOIN fx_registry r ON i.cnpj_fundo_classe = r.cnpj_fundo""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` preceded by the definitions it refers to, directly or not."""
    known = {**FX, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    tables = ", ".join(f"{name} AS ({known[name].strip()})" for name in needed)
    return f"WITH {tables} {body.strip()}" if needed else body.strip()
