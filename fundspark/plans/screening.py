"""Fund screening, fund lookup and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.text import format_tax_id, strip_tax_id
from fundspark.operators.aggregates import at_latest_date
from fundspark.operators.filters import MIN_TERM, name_contains, tax_id_or_name
from fundspark.operators.paging import flagged
from fundspark.operators.text_index import build_text_index, search_text_index


def fund_facts(daily: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered funds with net assets and holders of each series on its latest date."""
    latest = at_latest_date(daily, ["vl_patrim_liq", "nr_cotst"])
    names = registry.select(F.col("cnpj_fundo").alias("cnpj_fundo_classe"), "denominacao_social")
    return latest.join(names, "cnpj_fundo_classe").select(
        "cnpj_fundo_classe", "tp_fundo_classe", "id_subclasse", "dt_comptc", "denominacao_social",
        F.col("vl_patrim_liq").alias("patrimonio"),
        F.col("nr_cotst").alias("nr_cotistas"),
    )


def screen_funds(
    facts: DataFrame,
    name: str | None = None,
    assets: tuple[float, float] | None = None,
    holders: int | None = None,
) -> DataFrame:
    """Funds matching a name (three characters or more), an asset range and a holder count."""
    facts = name_contains(facts, "denominacao_social", name, MIN_TERM)
    if assets is not None:
        facts = facts.filter(F.col("patrimonio").between(*assets))
    if holders is not None:
        facts = facts.filter(F.col("nr_cotistas") == holders)
    return facts


def screen_funds_capped(facts: DataFrame, **criteria) -> DataFrame:
    """All hits of a screening with their number, flagged when the search should be refined."""
    order = ["denominacao_social", "cnpj_fundo_classe", "tp_fundo_classe", "id_subclasse"]
    return flagged(screen_funds(facts, **criteria), order)


def find_funds(registry: DataFrame, term: str) -> DataFrame:
    """Lookup by tax-id prefix or name substring, one option per way of matching."""
    ids = registry.select("cnpj_fundo", "denominacao_social")
    if len(term) < MIN_TERM:
        ids = ids.limit(0)
    by_id, by_name = tax_id_or_name(term, F.col("cnpj_fundo"), F.col("denominacao_social"))
    formatted = format_tax_id(F.col("cnpj_fundo"))
    name = F.col("denominacao_social")
    options = F.array(
        F.struct(
            by_id.alias("hit"), F.concat(F.lit("CNPJ: "), formatted).alias("label"),
            formatted.alias("value"), F.lit("CNPJ").alias("tipo"),
        ),
        F.struct(
            by_name.alias("hit"), F.concat(F.lit("Denominação: "), name).alias("label"),
            name.alias("value"), F.lit("Denominação Social").alias("tipo"),
        ),
    )
    return ids.filter(by_id | by_name).select(F.inline(options)).filter("hit").drop("hit").distinct()


def index_funds(registry: DataFrame, path: str) -> str:
    """The index that the ``_indexed`` searches read instead of the registry."""
    return build_text_index(registry, "cnpj_fundo", "denominacao_social", path)


def find_funds_indexed(spark: SparkSession, index: str, term: str) -> DataFrame:
    """:func:`find_funds` from an index: sorted tax ids by prefix, names by their trigrams."""
    digits = strip_tax_id(F.lit(term))
    keys = spark.read.parquet(f"{index}/keys").filter(digits != "").select(F.col("key").alias("cnpj_fundo"))
    # Stored ids are digits, so that the prefix reaches the scan as it is.
    prefix = spark.range(1).select(digits).first()[0]
    if len(term) < MIN_TERM:
        keys = keys.limit(0)
    formatted = format_tax_id(F.col("cnpj_fundo"))
    by_id = keys.filter(F.startswith("cnpj_fundo", F.lit(prefix))).select(
        F.concat(F.lit("CNPJ: "), formatted).alias("label"), formatted.alias("value"), F.lit("CNPJ").alias("tipo")
    )
    if len(term) < MIN_TERM:
        return by_id
    by_name = search_text_index(spark, index, term).select(
        F.concat(F.lit("Denominação: "), "text").alias("label"), F.col("text").alias("value"),
        F.lit("Denominação Social").alias("tipo"),
    )
    return by_id.unionByName(by_name).distinct()


def screen_funds_indexed(facts: DataFrame, index: str, name: str, **criteria) -> DataFrame:
    """:func:`screen_funds` with the name looked up in an index of the same registry."""
    if len(name) < MIN_TERM:
        return screen_funds(facts, **criteria)
    hits = search_text_index(facts.sparkSession, index, name)
    found = facts.join(
        hits, (F.col("cnpj_fundo_classe") == F.col("key")) & (F.col("denominacao_social") == F.col("text")), "left_semi"
    )
    return screen_funds(found, **criteria)


def create_basket(baskets: DataFrame, basket_id: int, name: str) -> DataFrame:
    """Append an empty basket; a blank name changes nothing."""
    name = name.strip()
    if not name:
        return baskets
    row = baskets.sparkSession.createDataFrame([(basket_id, name, "", [])], baskets.schema)
    return baskets.unionByName(row)


def find_baskets(baskets: DataFrame, search: str = "") -> DataFrame:
    return name_contains(baskets, "name", search)


def basket_members(baskets: DataFrame) -> DataFrame:
    """One row per basket and member, ids stripped; an empty basket has no rows."""
    members = F.transform("cnpjs", strip_tax_id)
    return baskets.select("id", "name", F.explode(members).alias("cnpj_fundo_classe"))


def basket_holdings(baskets: DataFrame, facts: DataFrame) -> DataFrame:
    """Basket members with name, type, net assets and date; unknown funds stay, empty."""
    return basket_members(baskets).join(
        facts.select(
            "cnpj_fundo_classe", "tp_fundo_classe", "id_subclasse", "denominacao_social",
            "patrimonio", "dt_comptc",
        ),
        "cnpj_fundo_classe",
        "left",
    )
