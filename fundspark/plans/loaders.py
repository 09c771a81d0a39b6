"""Loaders: landed files to clean, typed, deduplicated tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundspark import schemas
from fundspark.operators import columns, keys
from fundspark.session import shuffles_dropped, staged
from fundspark.sinks import parquet
from fundspark.sinks.counters import Counters
from fundspark.sources.delimited import LINE_ORDER, read_delimited
from fundspark.sources.files import BLOCK_MONTH, daily_files, portfolio_files

TEXT_LIMIT = 500
FILE_MONTH = "ym_arquivo"


def stored(spark: SparkSession, table: str, like: DataFrame) -> DataFrame:
    """A stored table with the types of the frame written to it, partition columns included."""
    return spark.read.schema(like.schema).parquet(table)


# Daily information ---------------------------------------------------------


def clean_daily(raw: DataFrame, on_loss: str = "fail") -> DataFrame:
    """Raw daily lines of any layout to the daily table's columns, one row per key (last wins)."""
    df = columns.rename_present(columns.lower_columns(raw), schemas.LAYOUT_RENAMES)
    df = columns.clean_tax_ids(columns.with_default(df, "id_subclasse", "NA"))
    typed = columns.conform(df, T.StructType([*schemas.DAILY, *_line_fields(df)]), on_loss=on_loss)
    return keys.dedup_keep(typed, schemas.DAILY_KEYS, LINE_ORDER).drop(*LINE_ORDER)


def _line_fields(df: DataFrame) -> list[T.StructField]:
    return [df.schema[name] for name in LINE_ORDER]


def _daily_lines(spark: SparkSession, folder: str, since: str, latest_only: bool) -> DataFrame:
    month_by_path = {f.path: f.month for f in daily_files(spark, folder, since, latest_only)}
    return read_delimited(
        spark, month_by_path, bad_lines="fail", alike=month_by_path.get,
        renames=schemas.LAYOUT_RENAMES,
    )


def daily_losses(spark: SparkSession, folder: str, since: str = "", latest_only: bool = False) -> DataFrame:
    """One row: per column of the daily table, how many values of the files would not fit it."""
    raw = columns.rename_present(
        columns.lower_columns(_daily_lines(spark, folder, since, latest_only)), schemas.LAYOUT_RENAMES
    )
    return columns.cast_losses(raw, schemas.DAILY)


def load_daily(
    spark: SparkSession,
    folder: str,
    table: str | None = None,
    since: str = "",
    latest_only: bool = False,
    on_loss: str = "fail",
    counters: Counters | None = None,
) -> DataFrame:
    """Load all daily files, or those since a month, or only the newest.

    A value that does not fit its column fails the load; ``on_loss="null"`` makes it NULL.

    With ``table`` the rows are upserted and the whole table is returned, with its
    month column, by which the date filters prune. ``counters`` gets the lines read (``lidas``)
    and the rows left of them (``gravadas``) from the job that writes them.
    """
    raw = _daily_lines(spark, folder, since, latest_only)
    if counters:
        raw = counters.of(raw, "lidas")
    daily = clean_daily(raw, on_loss)
    if counters:
        daily = counters.of(daily, "gravadas")
    if table is None:
        return daily
    parquet.upsert_table(spark, table, daily, schemas.DAILY_KEYS, month_of="dt_comptc")
    return stored(spark, table, parquet.with_month(daily))


# Registration --------------------------------------------------------------


def clean_registration(current: DataFrame, history: DataFrame, on_loss: str = "fail") -> DataFrame:
    """Current registrations (first line wins) and those known only from the name
    history (last line wins)."""

    def cleaned(raw: DataFrame, chars: dict[str, int]) -> DataFrame:
        df = columns.clean_tax_ids(columns.lower_columns(raw))
        return columns.fix_dates(columns.clean_chars(df, chars), schemas.REGISTRATION_DATES)

    now = cleaned(current, schemas.REGISTRATION_CHARS)
    now = keys.dedup_keep(now, schemas.REGISTRATION_KEYS, LINE_ORDER, keep="first")
    past = keys.without(cleaned(history, schemas.HISTORY_CHARS), now, schemas.REGISTRATION_KEYS)
    past = keys.dedup_keep(past, schemas.REGISTRATION_KEYS, LINE_ORDER, keep="last")
    both = now.unionByName(past.drop(*schemas.HISTORY_DROPPED), allowMissingColumns=True)
    cut = columns.cut_text(both, {"denom_social": TEXT_LIMIT, "trib_lprazo": TEXT_LIMIT})
    return columns.conform(cut.drop(*LINE_ORDER), schemas.REGISTRATION, on_loss=on_loss)


def load_registration(
    spark: SparkSession, current: str, history: str, table: str | None = None
) -> DataFrame:
    registration = clean_registration(
        read_delimited(spark, [current], bad_lines="fail"), read_delimited(spark, [history])
    )
    if table is None:
        return registration
    parquet.upsert_table(spark, table, registration, schemas.REGISTRATION_KEYS)
    return spark.read.parquet(table)


# Fund, class and subclass registry ------------------------------------------


def _clean_registry(raw: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    df = columns.rename_present(columns.lower_columns(raw), schemas.REGISTRY_CLASS_RENAMES)
    df = columns.cut_text(columns.clean_tax_ids(df), {"denominacao_social": TEXT_LIMIT})
    typed = columns.conform(df, T.StructType([*schema, *_line_fields(df)]), on_loss="fail")
    return keys.dedup_keep(typed, [key], LINE_ORDER).drop(*LINE_ORDER)


def clean_funds(raw: DataFrame) -> DataFrame:
    return _clean_registry(raw, schemas.REGISTRY_FUND, "id_registro_fundo")


def clean_classes(raw: DataFrame) -> DataFrame:
    return _clean_registry(raw, schemas.REGISTRY_CLASS, "id_registro_classe")


def clean_subclasses(raw: DataFrame) -> DataFrame:
    return _clean_registry(raw, schemas.REGISTRY_SUBCLASS, "id_subclasse")


class Registry(NamedTuple):
    funds: DataFrame
    classes: DataFrame
    subclasses: DataFrame


def load_registry(
    spark: SparkSession,
    funds_file: str,
    classes_file: str,
    subclasses_file: str,
    tables: tuple[str, str, str] | None = None,
) -> Registry:
    """Load the three registry files; classes need a known fund, subclasses a known class.

    With ``tables`` each level is upserted before the next one is checked against
    it, so parents from earlier loads count as known.
    """
    funds = clean_funds(read_delimited(spark, [funds_file]))
    classes = clean_classes(read_delimited(spark, [classes_file]))
    subclasses = clean_subclasses(read_delimited(spark, [subclasses_file]))
    if tables is None:
        known = keys.with_parent(classes, funds, ["id_registro_fundo"])
        return Registry(funds, known, keys.with_parent(subclasses, known, ["id_registro_classe"]))

    fund_table, class_table, subclass_table = tables
    parquet.upsert_table(spark, fund_table, funds, ["id_registro_fundo"])
    all_funds = spark.read.parquet(fund_table)
    known = keys.with_parent(classes, all_funds, ["id_registro_fundo"])
    parquet.upsert_table(spark, class_table, known, ["id_registro_classe"])
    all_classes = spark.read.parquet(class_table)
    parquet.upsert_table(
        spark,
        subclass_table,
        keys.with_parent(subclasses, all_classes, ["id_registro_classe"]),
        ["id_subclasse"],
        schemas.REGISTRY_SUBCLASS_UPDATES,
    )
    return Registry(all_funds, all_classes, spark.read.parquet(subclass_table))


# Portfolio -----------------------------------------------------------------


def positions_schema() -> T.StructType:
    """All columns of all blocks, the block's origin and the file's month."""
    fields = {f.name: f for block in schemas.BLOCKS for f in schemas.block_schema(block)}
    tags = [T.StructField(name, T.StringType()) for name in ("origem_tabela", FILE_MONTH)]
    return T.StructType([*fields.values(), *tags])


def clean_block(
    raw: DataFrame, block: int, keep: Sequence[str] = (), on_loss: str = "fail"
) -> DataFrame:
    """Lines of one block in the block's schema; ``keep`` names extra columns to carry."""
    df = columns.clean_tax_ids(raw.drop(*[c for c in LINE_ORDER if c not in keep]))
    extra = [df.schema[name] for name in keep]
    return columns.conform(df, T.StructType([*schemas.block_schema(block), *extra]), on_loss=on_loss)


def load_portfolio(
    spark: SparkSession, folder: str, table: str | None = None, on_loss: str = "fail"
) -> DataFrame:
    """All portfolio block files as one frame with ``origem_tabela`` and
    ``ym_arquivo``, the month the file was published for.

    ``table`` is partitioned by origin and by the month of ``dt_comptc``, by which the date
    filters prune; the partitions that occur in the files are replaced, others stay.
    Missing input fails before that. Rows are dealt to the partitions with the columns that the
    files have; those of the other blocks, which are NULL, join them when they are written.
    """
    files = portfolio_files(spark, folder)
    month_by_path = {f.path: f.month for f in files}
    frames = []
    for block in sorted({f.block for f in files}):
        paths = [f.path for f in files if f.block == block]
        renames = {**schemas.LAYOUT_RENAMES, **(schemas.QUOTA_BLOCK_RENAMES if block == 2 else {})}
        raw = read_delimited(spark, paths, alike=month_by_path.get, renames=renames)
        rows = clean_block(raw, block, keep=["_file"], on_loss=on_loss).withColumns(
            {
                "origem_tabela": F.lit(schemas.ORIGINS[block]),
                FILE_MONTH: F.regexp_extract("_file", BLOCK_MONTH, 1),
            }
        )
        held = {*raw.columns, "dt_comptc", "origem_tabela", FILE_MONTH} - {"_file"}
        frames.append(rows.select(*[c for c in rows.columns if c in held]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if table is None:
        return columns.conform(rows, positions_schema())
    like = parquet.with_month(columns.conform(rows, positions_schema()))
    dealt = parquet.dealt(parquet.with_month(rows), ["origem_tabela", parquet.MONTH])
    with shuffles_dropped(spark):
        parquet.refresh_partitions(
            columns.conform(dealt, like.schema), table, ["origem_tabela", parquet.MONTH], balance=False
        )
    return stored(spark, table, like)


# Derived tables -------------------------------------------------------------


def refresh_silver(
    daily: DataFrame, registry: DataFrame, folder: str, days: int = 31
) -> dict[str, str]:
    """Rebuild the manager ranking, the flow ranking and the date table under ``folder``.

    The inputs are evaluated once. Rankings are stored in rank order, so that a page reads
    the files and row groups of its ranks only.
    """
    from fundspark.plans import rankings

    daily, registry = staged(daily, "daily"), staged(registry, "registry")
    frames = {
        "ranking_gestores": rankings.manager_aum_ranking(daily, registry),
        "ranking_movimentacao": rankings.flow_ranking(daily, registry, days),
        "datas_informacao_diaria": rankings.available_dates(daily),
    }
    return store_silver(frames, folder)


def store_silver(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Replace derived tables under ``folder``, rankings in rank order; returns their paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in frames}
    for name, frame in frames.items():
        conformed = columns.conform(parquet.stamped(frame), schemas.TABLES[name])
        ranked = "ranking" in conformed.columns
        if ranked:
            conformed = conformed.repartitionByRange("ranking").sortWithinPartitions("ranking")
        parquet.refresh(conformed, paths[name], balance=not ranked)
    return paths


def upsert_returns(spark: SparkSession, returns: DataFrame, table: str) -> DataFrame:
    conformed = columns.conform(returns, schemas.RETURNS)
    parquet.upsert_table(
        spark, table, conformed, schemas.KEYS["fundo_rentabilidade"], month_of="dt_comptc"
    )
    return stored(spark, table, parquet.with_month(conformed))
