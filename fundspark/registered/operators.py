"""Registered single operators over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundspark import fixtures as fx
from fundspark import schemas
from fundspark.functions import dates, numbers, text
from fundspark.operators import aggregates, columns, filters, keys, paging, ranking
from fundspark.plans import rankings
from fundspark.registered.base import doubles, register
from fundspark.sources.links import extract_links
from fundspark.sources.tables import read_table

SPLIT = "2024-01-20"
OVERLAP = "2024-01-15"


# Cleaning -----------------------------------------------------------------------


def tax_id_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Formatted, unpadded and personal ids in file-style columns."""
    padded = F.lpad(F.col("c_custkey").cast("string"), 14, "0")
    return fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"),
        text.format_tax_id(padded).alias("CNPJ_FUNDO"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).alias("CNPJ_ADMIN"),
        F.concat(F.lit("123.456."), F.col("c_nationkey").cast("string"), F.lit("-01")).alias("CPF_CNPJ_GESTOR"),
    )


@register("clean_tax_ids")
def _(spark, sf):
    return columns.lower_columns(columns.clean_tax_ids(tax_id_frame(spark, sf)))


@register("strip_tax_ids")
def _(spark, sf):
    return columns.lower_columns(columns.clean_tax_ids(tax_id_frame(spark, sf), pad=False))


@register("cut_text")
def _(spark, sf):
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return columns.cut_text(customers, {"c_name": 12, "c_mktsegment": 500, "absent": 3})


def _coded_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows with the kinds of code and date text the disclosure files contain."""
    priority = F.substring("o_orderpriority", 1, 1)
    code = (
        F.when(priority == "1", " S ").when(priority == "2", "SIM").when(priority == "3", " ")
        .when(priority == "4", "")
    )
    day = (
        F.when(priority == "1", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(priority == "2", "2024-99-01").when(priority == "3", " ").when(priority == "4", "0202-01-01")
    )
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", code.alias("entid_invest"), code.alias("pf_pj_gestor"), day.alias("dt_reg")
    )


@register("clean_chars")
def _(spark, sf):
    return columns.clean_chars(_coded_orders(spark, sf), schemas.REGISTRATION_CHARS).drop("dt_reg")


@register("fix_invalid_dates")
def _(spark, sf):
    fixed = columns.fix_dates(_coded_orders(spark, sf), schemas.REGISTRATION_DATES)
    return fixed.select("o_orderkey", "dt_reg")


@register("fix_invalid_dates_in_range")
def _(spark, sf):
    fixed = columns.fix_dates(_coded_orders(spark, sf), ["dt_reg"], nanosecond_range=True)
    return fixed.select("o_orderkey", "dt_reg")


@register("layout_drift")
def _(spark, sf):
    old = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("CNPJ_FUNDO"),
        F.lit("FI").alias("TP_FUNDO"), F.col("s_name").alias("DENOM_SOCIAL"), F.lit(1).alias("UNUSED"),
    )
    renamed = columns.rename_present(columns.lower_columns(old), schemas.LAYOUT_RENAMES)
    return columns.with_default(renamed, "id_subclasse", "NA").drop("unused")


@register("fill_missing_key")
def _(spark, sf):
    daily = fx.daily(spark, sf).select(
        "cnpj_fundo_classe", "dt_comptc", "nr_cotst",
        F.nullif("id_subclasse", F.lit("NA")).alias("id_subclasse"),
    )
    return columns.with_default(daily, "id_subclasse", "NA")


def _loose_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as text, some values too long or unreadable for the target type."""
    price = F.col("l_extendedprice").cast("decimal(19,2)").cast("string")
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id_registro_fundo"),
        F.when(F.col("l_returnflag") == "R", F.concat(price, F.lit("x"))).otherwise(price).alias("vl_total"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("9" * 30), price)).otherwise(price).alias("vl_quota"),
        F.col("l_linenumber").alias("linha"),
    )


LOOSE_SCHEMA = T.StructType(
    [
        T.StructField("id_registro_fundo", T.LongType()),
        T.StructField("linha", T.IntegerType()),
        T.StructField("vl_total", T.DecimalType(19, 2)),
        T.StructField("vl_quota", T.DecimalType(19, 2)),
        T.StructField("diretor", T.StringType()),
    ]
)


@register("conform")
def _(spark, sf):
    return doubles(columns.conform(_loose_lines(spark, sf), LOOSE_SCHEMA))


@register("cast_losses")
def _(spark, sf):
    return columns.cast_losses(_loose_lines(spark, sf), LOOSE_SCHEMA)


@register("serving_shape")
def _(spark, sf):
    daily = fx.daily(spark, sf).select(*schemas.DAILY_KEYS, "captc_dia", "resg_dia", "vl_quota")
    return columns.serve(daily, zero=["captc_dia", "resg_dia"], nullable=["vl_quota"])


@register("finite_or_null")
def _(spark, sf):
    ratio = F.when(F.col("l_tax") != 0, F.col("l_discount") / F.col("l_tax")).when(
        F.col("l_discount") == 0, float("nan")
    ).otherwise(float("inf"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.finite_or_null(ratio).alias("ratio")
    )


@register("lineage")
def _(spark, sf):
    rows = columns.with_lineage(fx.table(spark, sf, "orders"))
    return rows.groupBy("arquivo_origem").agg(
        F.count("*").alias("linhas"), F.count("data_processamento").alias("com_data")
    )


@register("in_millions")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", numbers.in_millions(F.col("c_acctbal")).alias("milhoes")
    )


# Scalar functions -----------------------------------------------------------------


@register("percent_change")
def _(spark, sf):
    daily = fx.daily(spark, sf)
    change = numbers.percent_change(F.col("vl_total"), F.col("vl_quota"))
    return daily.select(*schemas.DAILY_KEYS, change.alias("variacao_percentual"))


@register("round_half_even")
def _(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numbers.round_half_even(F.col("l_extendedprice") / 8, 2).alias("valor"),
    )


@register("join_text")
def _(spark, sf):
    registry = fx.registry(spark, sf)
    joined = text.join_text(F.col("cpf_cnpj_gestor"), F.col("gestor"))
    return registry.select("id_registro_fundo", joined.alias("chave"))


@register("parse_or_default")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", " ").when(F.col("o_orderstatus") == "F", "12x").otherwise(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", numbers.parse_or(raw, "long", 1).alias("fator"))


@register("compact_dates")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "20241332").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return fx.table(spark, sf, "orders").select("o_orderkey", dates.compact_date(raw).alias("data"))


@register("month_tokens")
def _(spark, sf):
    name = F.concat(F.lit("inf_diario_fi_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv"))
    name = F.when(F.col("o_orderstatus") == "F", "sem_data.csv").otherwise(name)
    return fx.table(spark, sf, "orders").select("o_orderkey", dates.month_token(name).alias("mes"))


@register("day_buckets")
def _(spark, sf):
    events = fx.table(spark, sf, "events")
    return events.groupBy(dates.day_bucket(F.col("ts")).alias("dia")).agg(F.count("*").alias("linhas"))


# Filters ---------------------------------------------------------------------------


def _keys_of(df: DataFrame) -> DataFrame:
    return df.select(*schemas.DAILY_KEYS)


FILTERS = {
    "date_range_both": lambda d: filters.date_range(d, "2024-01-05", "2024-01-12"),
    "date_range_from": lambda d: filters.date_range(d, start="2024-01-25"),
    "date_range_until": lambda d: filters.date_range(d, end="2024-01-03"),
    "date_range_open": lambda d: filters.date_range(d),
    "latest_date_rows": lambda d: filters.date_range_or_latest(d),
    "trailing_day": lambda d: filters.trailing_period(d, "dia"),
    "trailing_7_days": lambda d: filters.trailing_period(d, "7_dias"),
    "trailing_31_days": lambda d: filters.trailing_period(d, "31_dias"),
    "trailing_unknown": lambda d: filters.trailing_period(d, "ano"),
    "class_funds": filters.class_funds,
    "positive_assets": lambda d: filters.positive(d, "vl_patrim_liq"),
    "any_flow": filters.any_flow,
    "in_list": lambda d: filters.one_of(d, "tp_fundo_classe", ["FI", "CLASSES - FIF"]),
    "in_empty_list": lambda d: filters.one_of(d, "tp_fundo_classe", []),
    "one_vehicle": lambda d: filters.vehicle(d, "00000000000003", "CLASSES - FIF"),
}
for _name, _filter in FILTERS.items():
    register(_name)(lambda spark, sf, _filter=_filter: _keys_of(_filter(fx.daily(spark, sf))))


@register("in_long_list")
def _(spark, sf):
    registered = fx.registry(spark, sf).select("cnpj_fundo")
    return _keys_of(filters.one_of(fx.daily(spark, sf), "cnpj_fundo_classe", registered))


@register("named_managers")
def _(spark, sf):
    return filters.named_manager(fx.registry(spark, sf)).select("id_registro_fundo")


@register("not_cancelled")
def _(spark, sf):
    situation = F.when(F.col("cpf_cnpj_gestor").isNotNull(), F.col("situacao"))
    registry = fx.registry(spark, sf).withColumn("situacao", situation)
    return filters.not_cancelled(registry).select("id_registro_fundo")


@register("read_with_predicate")
def _(spark, sf):
    return read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F")


# Joins and aggregates -----------------------------------------------------------------


@register("missing_in_registry")
def _(spark, sf):
    registry = fx.registry(spark, sf).select(F.col("cnpj_fundo").alias("cnpj_fundo_classe"))
    return _keys_of(keys.without(fx.daily(spark, sf), registry, ["cnpj_fundo_classe"]))


@register("with_parent")
def _(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keys.with_parent(orders, customers, ["o_custkey"])


@register("latest_per_vehicle")
def _(spark, sf):
    return aggregates.latest_per_vehicle(fx.daily(spark, sf))


@register("at_latest_date")
def _(spark, sf):
    return doubles(aggregates.at_latest_date(fx.daily(spark, sf), ["vl_total", "nr_cotst"]))


@register("flow_sums")
def _(spark, sf):
    return doubles(rankings.flow_sums(fx.daily(spark, sf)))


@register("latest_date")
def _(spark, sf):
    return fx.daily(spark, sf).agg(F.max("dt_comptc").alias("ultima_data"))


@register("count_with_filter")
def _(spark, sf):
    return filters.trailing_period(fx.daily(spark, sf), "7_dias").agg(F.count("*").alias("total"))


@register("distinct_funds")
def _(spark, sf):
    return fx.daily(spark, sf).select("cnpj_fundo_classe").distinct()


@register("union_by_name")
def _(spark, sf):
    current = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"))
    older = fx.table(spark, sf, "supplier").select(
        F.col("s_name").alias("nome"), F.col("s_acctbal").alias("saldo"), F.col("s_suppkey").alias("id")
    )
    return current.unionByName(older, allowMissingColumns=True)


# Keys ------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")


EVENT_KEYS = ["user_id", "event_type"]


@register("dedup_keep_last")
def _(spark, sf):
    return keys.dedup_keep(_events(spark, sf), EVENT_KEYS, ["event_id"])


@register("dedup_keep_first")
def _(spark, sf):
    return keys.dedup_keep(_events(spark, sf), EVENT_KEYS, ["event_id"], keep="first")


@register("duplicate_report")
def _(spark, sf):
    return keys.duplicate_report(_events(spark, sf), EVENT_KEYS)


@register("dedup_counters")
def _(spark, sf):
    return keys.dedup_counters(_events(spark, sf), EVENT_KEYS)


def upsert_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily rows until the split, and later rows with changed or emptied unit values."""
    daily = fx.daily(spark, sf)
    changed = F.when(F.col("resg_dia").isNotNull(), F.col("vl_quota") + 1).cast("decimal(27,12)")
    newer = filters.date_range(daily, start=OVERLAP).withColumn("vl_quota", changed)
    return filters.date_range(daily, end=SPLIT), newer


@register("merge_upsert")
def _(spark, sf):
    return doubles(keys.merge_upsert(*upsert_frames(spark, sf), schemas.DAILY_KEYS))


@register("merge_upsert_some_columns")
def _(spark, sf):
    target, source = upsert_frames(spark, sf)
    source = source.withColumn("nr_cotst", F.lit(-1))
    return doubles(keys.merge_upsert(target, source, schemas.DAILY_KEYS, ["vl_quota", "vl_total"]))


# Ranks and lags ------------------------------------------------------------------------------


@register("global_rank_placed")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [
        F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_partkey"), F.col("l_suppkey"),
    ]
    return ranking.global_rank(lines, order)


@register("rank_in_group_stitched")
def _(spark, sf):
    order = [F.col("value").desc_nulls_first(), F.col("event_id")]
    return ranking.rank_in_group(
        _events(spark, sf).drop("props"), ["event_type"], order, "posicao",
    )


@register("lag_in_group_stitched")
def _(spark, sf):
    lags = {"valor_anterior": "value", "evento_anterior": "event_id"}
    return ranking.lag_in_group(
        _events(spark, sf).drop("props"), ["event_type"], [F.col("event_id")], lags,
    )


@register("page_of_orders")
def _(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return paging.page(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 3, 30)


@register("deep_page_of_lines")
def _(spark, sf):
    """A page far behind the first ones."""
    lines = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    order = [F.col("l_extendedprice").desc(), *[c for c in lines.columns if c != "l_extendedprice"]]
    return paging.page(lines, order, 190, 30).drop("l_shipdate")


# Links ------------------------------------------------------------------------------------------


@register("extract_links")
def _(spark, sf):
    return extract_links(fx.table(spark, sf, "pages"), suffix="n", base="https://example.org/dados")
