"""Table schemas, rename maps and portfolio block facts.

Column names and keys are fixed by the published disclosure files. Types follow
one rule on the column name (``_type_of``); the few exceptions are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DATE_PREFIXES = ("dt_", "data_")


def _type_of(name: str) -> T.DataType:
    if name.startswith(DATE_PREFIXES):
        return T.DateType()
    if name.startswith("vl_"):
        return T.DecimalType(19, 2)
    if name.startswith("qt_"):
        return T.DecimalType(21, 6)
    if name.startswith("pr_"):
        return T.DecimalType(9, 6)
    if name in ("cd_cvm", "codigo_cvm"):
        return T.DecimalType(7, 0)
    if name == "patrimonio_liquido":
        return T.DecimalType(24, 2)
    if name in ("id_registro_fundo", "id_registro_classe"):
        return T.LongType()
    return T.StringType()


def _schema(names: str, **exceptions: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(n, exceptions.get(n, _type_of(n)), True) for n in names.split()]
    )


MONEY = T.DecimalType(17, 2)
# Fund and daily disclosure -------------------------------------------------

DAILY = _schema(
    "cnpj_fundo_classe dt_comptc id_subclasse tp_fundo_classe captc_dia nr_cotst"
    " resg_dia vl_patrim_liq vl_quota vl_total",
    captc_dia=MONEY,
    nr_cotst=T.IntegerType(),
    resg_dia=MONEY,
    vl_patrim_liq=MONEY,
    vl_quota=T.DecimalType(27, 12),
    vl_total=MONEY,
)
DAILY_KEYS = ["cnpj_fundo_classe", "dt_comptc", "id_subclasse", "tp_fundo_classe"]
VEHICLE = ["cnpj_fundo_classe", "tp_fundo_classe"]

REGISTRATION = _schema(
    "admin auditor cd_cvm classe classe_anbima cnpj_admin cnpj_auditor"
    " cnpj_controlador cnpj_custodiante cnpj_fundo condom controlador"
    " cpf_cnpj_gestor custodiante denom_social diretor dt_cancel dt_const"
    " dt_fim_exerc dt_ini_ativ dt_ini_classe dt_ini_exerc dt_ini_sit"
    " dt_patrim_liq dt_reg entid_invest fundo_cotas fundo_exclusivo gestor"
    " inf_taxa_adm inf_taxa_perfm invest_cempr_exter pf_pj_gestor publico_alvo"
    " rentab_fundo sit taxa_adm taxa_perfm tp_fundo trib_lprazo vl_patrim_liq",
    taxa_adm=T.FloatType(),
    taxa_perfm=T.FloatType(),
    vl_patrim_liq=T.DecimalType(24, 2),
)
REGISTRATION_KEYS = ["cnpj_fundo"]
REGISTRATION_DATES = [f.name for f in REGISTRATION if f.name.startswith("dt_")]
# Fixed widths of the short-code columns; the history file also cuts trib_lprazo.
REGISTRATION_CHARS = {
    "entid_invest": 1,
    "fundo_cotas": 1,
    "fundo_exclusivo": 1,
    "invest_cempr_exter": 1,
    "pf_pj_gestor": 2,
}
HISTORY_CHARS = {**REGISTRATION_CHARS, "trib_lprazo": 3}
HISTORY_DROPPED = ["dt_ini_denom_social", "dt_fim_denom_social"]

REGISTRY_FUND = _schema(
    "id_registro_fundo cnpj_fundo codigo_cvm data_registro data_constituicao"
    " tipo_fundo denominacao_social data_cancelamento situacao"
    " data_inicio_situacao data_adaptacao_rcvm175 data_inicio_exercicio_social"
    " data_fim_exercicio_social patrimonio_liquido data_patrimonio_liquido diretor"
    " cnpj_administrador administrador tipo_pessoa_gestor cpf_cnpj_gestor gestor"
)
REGISTRY_CLASS = _schema(
    "id_registro_classe id_registro_fundo cnpj_classe codigo_cvm data_registro"
    " data_constituicao data_inicio tipo_classe denominacao_social situacao"
    " classificacao identificador_desempenho classe_cotas classificacao_anbima"
    " tributacao_longo_prazo entidade_investimento"
    " permitido_aplicacao_cem_por_cento_exterior classe_esg forma_condominio"
    " exclusivo patrimonio_liquido data_patrimonio_liquido publico_alvo"
    " cnpj_auditor auditor cnpj_custodiante custodiante cnpj_controlador"
    " controlador"
)
# Headers of the class file that differ from the table by more than case.
REGISTRY_CLASS_RENAMES = {
    "indicador_desempenho": "identificador_desempenho",
    "permitido_aplicacao_cemporcento_exterior": "permitido_aplicacao_cem_por_cento_exterior",
}
REGISTRY_SUBCLASS = _schema(
    "id_subclasse id_registro_classe codigo_cvm data_constituicao data_inicio"
    " denominacao_social situacao forma_condominio exclusivo publico_alvo"
)
# A conflicting subclass keeps the class it was first filed under.
REGISTRY_SUBCLASS_UPDATES = [
    f.name for f in REGISTRY_SUBCLASS if f.name not in ("id_subclasse", "id_registro_classe")
]

# Older daily and portfolio files use the left-hand names.
LAYOUT_RENAMES = {"tp_fundo": "tp_fundo_classe", "cnpj_fundo": "cnpj_fundo_classe"}
QUOTA_BLOCK_RENAMES = {"cnpj_fundo_cota": "cnpj_fundo_classe_cota"}

# Portfolio blocks ----------------------------------------------------------

POSITION_COLUMNS = (
    "cnpj_fundo_classe dt_comptc denom_social dt_confid_aplic emissor_ligado"
    " qt_aquis_negoc qt_pos_final qt_venda_negoc tp_aplic tp_ativo tp_fundo_classe"
    " tp_negoc vl_aquis_negoc vl_custo_pos_final vl_merc_pos_final vl_venda_negoc"
)
# block number -> (origin tag, asset code column, isin column, own columns)
BLOCKS = {
    1: ("TITULO_PUBLICO_SELIC", "cd_selic", "cd_isin",
        "cd_isin cd_selic dt_emissao dt_venc tp_fundo tp_titpub"),
    2: ("FUNDOS", "cnpj_fundo_classe_cota", None,
        "id_subclasse nm_fundo_cota cnpj_fundo_classe_cota nm_fundo_classe_subclasse_cota"),
    3: ("SWAPS", "cd_swap", None, "cd_swap ds_swap"),
    4: ("DEMAIS_CODIFICADOS", "cd_ativo", "cd_isin",
        "cd_ativo cd_isin ds_ativo dt_fim_vigencia dt_ini_vigencia"),
    5: ("DEPOSITO_PRAZO_IF", "cnpj_emissor", None,
        "ag_risco cd_indexador_posfx cnpj_emissor ds_indexador_posfx dt_risco dt_venc"
        " emissor grau_risco pr_cupom_posfx pr_indexador_posfx pr_taxa_prefx"
        " risco_emissor titulo_posfx"),
    6: ("TITULO_PRIVADO", "cpf_cnpj_emissor", None,
        "cd_indexador_posfx cnpj_instituicao_financ_coobr cpf_cnpj_emissor"
        " ds_indexador_posfx dt_venc emissor pf_pj_emissor pr_cupom_posfx"
        " pr_indexador_posfx pr_taxa_prefx titulo_cetip titulo_garantia titulo_posfx"),
    7: ("INVESTIMENTO_EXTERIOR", "cd_ativo_bv_merc", None,
        "ag_risco bv_merc cd_ativo_bv_merc cd_bv_merc cd_pais ds_ativo_exterior"
        " dt_risco dt_venc emissor grau_risco invest_coletivo invest_coletivo_gestor"
        " pais qt_ativo_exterior risco_emissor vl_ativo_exterior"),
    8: ("NAO_CODIFICADOS", "cpf_cnpj_emissor", None,
        "cpf_cnpj_emissor ds_ativo emissor pf_pj_emissor"),
}
ORIGINS = {block: facts[0] for block, facts in BLOCKS.items()}
EQUITY_ORIGIN = "DEMAIS_CODIFICADOS"
EQUITY_APPLICATION = "Ações"
# The widest Spark decimal; the published column allows 53 digits.
_BLOCK_EXCEPTIONS = {
    "qt_ativo_exterior": T.DecimalType(18, 0),
    "vl_ativo_exterior": T.DecimalType(38, 0),
}


def block_schema(block: int) -> T.StructType:
    return _schema(f"{POSITION_COLUMNS} {BLOCKS[block][3]}", **_BLOCK_EXCEPTIONS)


def block_table(block: int) -> str:
    return f"composicao_carteira_{ORIGINS[block].lower()}"


# Derived tables ------------------------------------------------------------

AUM_RANKING = _schema(
    "cpf_cnpj_gestor gestor numero_veiculos patrimonio_total_sob_gestao ranking dt_criacao",
    numero_veiculos=T.LongType(),
    patrimonio_total_sob_gestao=T.DecimalType(27, 2),
    ranking=T.LongType(),
    dt_criacao=T.TimestampType(),
)
FLOW_RANKING = _schema(
    "cnpj_fundo_classe tp_fundo_classe dt_comptc denominacao_social vl_total"
    " total_resgates total_aportes fluxo_liquido percentual_fluxo_liquido ranking"
    " dt_criacao",
    vl_total=MONEY,
    total_resgates=T.DecimalType(27, 2),
    total_aportes=T.DecimalType(27, 2),
    fluxo_liquido=T.DecimalType(27, 2),
    percentual_fluxo_liquido=T.DecimalType(10, 2),
    ranking=T.LongType(),
    dt_criacao=T.TimestampType(),
)
DATES = _schema("dt_comptc dt_criacao", dt_criacao=T.TimestampType())
RETURNS = _schema(
    "cnpj_fundo_classe tp_fundo_classe id_subclasse dt_comptc vl_log_quota",
    vl_log_quota=T.DoubleType(),
)
BASKETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("descricao", T.StringType()),
        T.StructField("cnpjs", T.ArrayType(T.StringType())),
    ]
)

TABLES: dict[str, T.StructType] = {
    "informacao_cadastral": REGISTRATION,
    "informacao_diaria": DAILY,
    **{block_table(b): block_schema(b) for b in BLOCKS},
    "registro_fundo": REGISTRY_FUND,
    "registro_classe": REGISTRY_CLASS,
    "registro_subclasse": REGISTRY_SUBCLASS,
    "ranking_gestores": AUM_RANKING,
    "ranking_movimentacao": FLOW_RANKING,
    "datas_informacao_diaria": DATES,
    "fundo_rentabilidade": RETURNS,
}
KEYS = {
    "informacao_cadastral": REGISTRATION_KEYS,
    "informacao_diaria": DAILY_KEYS,
    "registro_fundo": ["id_registro_fundo"],
    "registro_classe": ["id_registro_classe"],
    "registro_subclasse": ["id_subclasse"],
    "fundo_rentabilidade": ["cnpj_fundo_classe", "tp_fundo_classe", "id_subclasse", "dt_comptc"],
    "datas_informacao_diaria": ["dt_comptc"],
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def bootstrap_views(spark: SparkSession) -> list[str]:
    """Give every table that does not exist yet an empty view of its schema."""
    missing = [name for name in TABLES if not spark.catalog.tableExists(name)]
    for name in missing:
        empty_table(spark, name).createOrReplaceTempView(name)
    return missing
