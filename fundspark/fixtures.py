"""The domain tables derived from the generic test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.text import format_tax_id
from fundspark.schemas import BLOCKS, ORIGINS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(column: Column | str) -> Column:
    return F.lpad((F.col(column) if isinstance(column, str) else column).cast("string"), 14, "0")


def _fund_type(number: Column) -> Column:
    return (
        F.when(number % 3 == 0, "CLASSES - FIF").when(number % 3 == 1, "FI").otherwise("CLASSES - FIDC")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped on numbers; the text keys are derived from the groups."""
    events = table(spark, sf_dir, "events")
    kind, money = F.col("event_type"), F.col("value").cast("decimal(17,2)")

    def total(*kinds: str) -> Column:
        return F.sum(F.when(kind.isin(*kinds), money))

    half = F.when(F.col("user_id") % 7 == 0, F.col("event_id") % 2)
    groups = events.groupBy(
        "user_id", F.col("ts").cast("date").alias("dt_comptc"), half.alias("half")
    ).agg(
        total("purchase").cast("decimal(17,2)").alias("captc_dia"),
        F.count("*").cast("int").alias("nr_cotst"),
        total("error").cast("decimal(17,2)").alias("resg_dia"),
        total("signup").cast("decimal(17,2)").alias("vl_patrim_liq"),
        F.coalesce(total("view", "click"), F.lit(0)).cast("decimal(27,12)").alias("vl_quota"),
        F.sum(money).cast("decimal(17,2)").alias("vl_total"),
    )
    subclass = F.coalesce(F.concat(F.lit("S"), F.col("half").cast("string")), F.lit("NA"))
    return groups.select(
        _id("user_id").alias("cnpj_fundo_classe"), "dt_comptc", subclass.alias("id_subclasse"),
        _fund_type(F.col("user_id")).alias("tp_fundo_classe"),
        "captc_dia", "nr_cotst", "resg_dia", "vl_patrim_liq", "vl_quota", "vl_total",
    )


UNKNOWN_OFFSET = 500000000


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    running = "Em Funcionamento Normal"
    manager = F.lpad(nation.cast("string"), 11, "0")
    # Customers in debt are registered under tax ids that no daily row has.
    tax_id = F.when(F.col("c_acctbal") < 0, key + UNKNOWN_OFFSET).otherwise(key)
    first = named.select(
        key.alias("id_registro_fundo"), _id(tax_id).alias("cnpj_fundo"),
        F.col("c_name").alias("denominacao_social"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Cancelado").otherwise(running).alias("situacao"),
        F.when(nation % 8 != 0, manager).alias("cpf_cnpj_gestor"),
        F.col("n_name").alias("gestor"),
    )
    second = named.filter(F.col("c_acctbal") > 9500).select(
        (key + 100000000).alias("id_registro_fundo"), _id("c_custkey").alias("cnpj_fundo"),
        F.concat("c_name", F.lit(" B")).alias("denominacao_social"),
        F.lit(running).alias("situacao"), manager.alias("cpf_cnpj_gestor"),
        F.col("n_name").alias("gestor"),
    )
    return first.unionByName(second)


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped on numbers; the text keys are derived from the groups."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(19,2)")
    groups = lines.groupBy(
        (F.col("l_orderkey") % 8 + 1).cast("int").alias("tipo"),
        "l_suppkey",
        F.date_trunc("month", "l_shipdate").cast("date").alias("dt_comptc"),
        (F.col("l_returnflag") == "A").alias("equity"),
        F.col("l_linestatus").alias("tp_ativo"),
        (F.col("l_partkey") % 20).alias("asset"),
    ).agg(
        F.sum(F.when(F.col("l_linenumber") != 7, price)).cast("decimal(19,2)").alias("vl_merc_pos_final"),
        F.sum(F.col("l_quantity").cast("decimal(21,6)")).cast("decimal(21,6)").alias("qt_pos_final"),
    )
    return groups.select(
        "tipo", _id("l_suppkey").alias("cnpj_fundo_classe"), "dt_comptc",
        _fund_type(F.col("l_suppkey")).alias("tp_fundo_classe"),
        F.when(F.col("equity"), "Ações").otherwise("Debêntures").alias("tp_aplic"), "tp_ativo",
        F.concat(F.lit("A"), F.col("asset").cast("string")).alias("codigo_ativo"),
        "vl_merc_pos_final", "qt_pos_final",
    )


def block(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """One portfolio block under its own asset code column."""
    _, code, isin, _ = BLOCKS[number]
    rows = portfolio(spark, sf_dir).filter(F.col("tipo") == number)
    if isin:
        rows = rows.withColumn(isin, F.concat(F.lit("BR"), "codigo_ativo"))
    name = F.concat(F.lit("Fundo "), F.col("cnpj_fundo_classe"))
    return rows.withColumn("denom_social", name).withColumnRenamed("codigo_ativo", code).drop("tipo")


def blocks(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    return {number: block(spark, sf_dir, number) for number in BLOCKS}


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks in the common shape from one scan."""
    with_isin = [ORIGINS[b] for b, (_, _, isin, _) in BLOCKS.items() if isin]
    origin = F.element_at(F.array(*[F.lit(ORIGINS[b]) for b in sorted(ORIGINS)]), F.col("tipo"))
    return portfolio(spark, sf_dir).select(
        "cnpj_fundo_classe", "dt_comptc", "tp_fundo_classe", "tp_aplic", "tp_ativo",
        F.concat(F.lit("Fundo "), "cnpj_fundo_classe").alias("denominacao_social"),
        "codigo_ativo",
        F.when(origin.isin(with_isin), F.concat(F.lit("BR"), "codigo_ativo")).alias("cd_isin"),
        "vl_merc_pos_final", "qt_pos_final", origin.alias("origem_tabela"),
    )


BASKET_SIZE = 25


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets of 25 neighbouring customers; members are formatted tax ids."""
    basket = F.floor(F.col("c_custkey") / BASKET_SIZE)
    return table(spark, sf_dir, "customer").groupBy(basket.alias("id")).agg(
        F.concat(F.lit("Basket "), F.first(basket).cast("string")).alias("name"),
        F.lit("").alias("descricao"),
        F.array_sort(F.collect_list(format_tax_id(_id("c_custkey")))).alias("cnpjs"),
    )
