"""Registered loads: landed files, written from the test tables, through the loaders,
sinks and streams and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark import landed, schemas
from fundspark.operators import columns, filters, keys, sketches
from fundspark.plans import loaders, portfolio, quotes, rankings, returns, silver
from fundspark.registered.base import doubles, register
from fundspark.registered.operators import OVERLAP, upsert_frames
from fundspark.session import scratch_path
from fundspark.sinks import bucketed, counters, parquet, views
from fundspark.sources import archives, delimited, fixed_width
from fundspark.sources.files import list_files
from fundspark.sources.tables import stored_latest_date, stored_month_ranges
from fundspark.streaming import incremental, logs, tail

SINCE = "202312"
VEHICLE = ["cnpj_fundo_classe", "tp_fundo_classe"]
SKETCH_RANGES = {"dia": ("2024-01-05", "2024-01-05"), "semana": ("2024-01-08", "2024-01-14"), "tudo": (None, None), "nada": ("2030-01-01", None)}
TAIL_RANGE = 256 << 10
# Daily information ----------------------------------------------------------------


@register("load_daily")
def _(spark, sf):
    return doubles(loaders.load_daily(spark, landed.daily_folder(spark, sf), since=SINCE, latest_only=True))


@register("load_daily_all_months")
def _(spark, sf):
    folder = landed.daily_folder(spark, sf)
    return doubles(loaders.load_daily(spark, folder, since=SINCE))


@register("load_daily_table")
def _(spark, sf):
    table = scratch_path(spark, "informacao_diaria")
    parquet.refresh_partitions(parquet.with_month(upsert_frames(spark, sf)[1]), table, [parquet.MONTH])
    stored = loaders.load_daily(spark, landed.daily_folder(spark, sf), table, since=SINCE, latest_only=True)
    return doubles(stored.drop(parquet.MONTH))


@register("upsert_daily_table")
def _(spark, sf):
    table = scratch_path(spark, "informacao_diaria")
    for frame in upsert_frames(spark, sf):
        parquet.upsert_table(spark, table, frame, schemas.DAILY_KEYS, month_of="dt_comptc")
    return doubles(spark.read.parquet(table).drop(parquet.MONTH))


@register("upsert_returns")
def _(spark, sf):
    table = scratch_path(spark, "fundo_rentabilidade")
    first = returns.log_returns(fx.daily(spark, sf)).withColumn("vl_log_quota", F.lit(0.0))
    loaders.upsert_returns(spark, first, table)
    stored = loaders.upsert_returns(spark, returns.log_returns(fx.daily(spark, sf)), table)
    return stored.drop(parquet.MONTH).withColumn("vl_log_quota", F.round("vl_log_quota", 6))


@register("observed_counters")
def _(spark, sf):
    """Rows before and after dedup, counted while the deduplicated rows are written."""
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    before, seen = counters.counted(events, "before")
    after, kept = counters.counted(
        keys.dedup_keep(before, ["user_id", "event_type"], ["event_id"]), "after"
    )
    parquet.refresh(after, scratch_path(spark, "eventos"))
    row = [(seen.get["rows"], kept.get["rows"])]
    return spark.createDataFrame(row, "rows_before long, rows_after long")


@register("load_losses")
def _(spark, sf):
    """Per column, the values of damaged files that would not fit the daily table."""
    return loaders.daily_losses(spark, landed.damaged_daily_folder(spark, sf))


@register("load_daily_counters")
def _(spark, sf):
    """Lines read and rows left, counted by the job that writes the table."""
    seen = counters.Counters()
    table = scratch_path(spark, "informacao_diaria")
    loaders.load_daily(spark, landed.daily_folder(spark, sf), table, since=SINCE, counters=seen)
    return spark.createDataFrame([tuple(seen.get().values())], "lidas long, gravadas long")


@register("distinct_funds_sketch")
def _(spark, sf):
    """Distinct vehicles of date ranges from stored daily sketches, and whether they keep to the stated error."""
    kept = scratch_path(spark, "esbocos")
    daily = fx.daily(spark, sf)
    sketches.daily_sketches(daily, VEHICLE).write.parquet(kept)
    stored, out = spark.read.parquet(kept), None
    for name, (start, end) in SKETCH_RANGES.items():
        exact = filters.date_range(daily, start, end).select(*VEHICLE).distinct().agg(F.count("*").alias("exatos"))
        found = sketches.distinct_from_sketches(stored, start, end).withColumn("exatos", exact.scalar())
        near = F.abs(F.col("distintos") - F.col("exatos")) <= sketches.RELATIVE_ERROR * F.col("exatos")
        row = found.select(F.lit(name).alias("periodo"), "linhas", "exatos", near.alias("dentro_do_erro"))
        out = row if out is None else out.unionByName(row)
    return out


@register("stored_trailing_7_days")
def _(spark, sf):
    """A trailing period of a table partitioned by month: older months are not read."""
    table = scratch_path(spark, "informacao_diaria")
    parquet.refresh_partitions(parquet.with_month(fx.daily(spark, sf)), table, [parquet.MONTH])
    rows = filters.trailing_period(spark.read.parquet(table), "7_dias")
    return rows.select(*schemas.DAILY_KEYS)


def _daily_by_month(spark: SparkSession, sf: str) -> str:
    table = scratch_path(spark, "informacao_diaria")
    months = fx.daily(spark, sf).withColumn("dt_comptc", F.add_months("dt_comptc", F.col("nr_cotst") % 3))
    parquet.refresh_partitions(parquet.with_month(months), table, [parquet.MONTH])
    return table


@register("stored_latest_date")
def _(spark, sf):
    return stored_latest_date(spark, _daily_by_month(spark, sf))


@register("stored_month_ranges")
def _(spark, sf):
    return stored_month_ranges(spark, _daily_by_month(spark, sf))


# Registration and registry -----------------------------------------------------------


@register("load_registration")
def _(spark, sf):
    current, history = landed.registration_files(spark, sf)
    table = scratch_path(spark, "informacao_cadastral")
    loaded = loaders.load_registration(spark, current, history, table)
    rates = {c: F.col(c).cast("double") for c in ("taxa_adm", "taxa_perfm")}
    return doubles(loaded.withColumns(rates))


def _registry(spark: SparkSession, sf: str) -> loaders.Registry:
    tables = tuple(scratch_path(spark, name) for name in ("fundo", "classe", "subclasse"))
    return loaders.load_registry(spark, *landed.registry_files(spark, sf), tables)


@register("load_registry_funds")
def _(spark, sf):
    return _registry(spark, sf).funds.select(
        "id_registro_fundo", "cnpj_fundo", "denominacao_social", "situacao", "cpf_cnpj_gestor",
        "gestor", "data_registro",
    )


@register("load_registry_classes")
def _(spark, sf):
    return doubles(
        _registry(spark, sf).classes.select(
            "id_registro_classe", "id_registro_fundo", "cnpj_classe", "denominacao_social",
            "identificador_desempenho", "permitido_aplicacao_cem_por_cento_exterior",
            "patrimonio_liquido",
        )
    )


@register("load_registry_subclasses")
def _(spark, sf):
    return doubles(
        _registry(spark, sf).subclasses.select(
            "id_subclasse", "id_registro_classe", "codigo_cvm", "data_inicio",
            "denominacao_social", "exclusivo",
        )
    )


BUCKETS = 16


@register("upsert_registry_bucketed")
def _(spark, sf):
    """The fund registry in hash buckets after a small upsert of renamed and of new funds."""
    table = scratch_path(spark, "registro_baldes")
    registry = fx.registry(spark, sf)
    bucketed.upsert_buckets(spark, table, registry, ["id_registro_fundo"], buckets=BUCKETS)
    some = registry.filter(F.col("id_registro_fundo") % 40 == 0)
    renamed = some.withColumn("denominacao_social", F.concat("denominacao_social", F.lit(" Z")))
    added = some.withColumn("id_registro_fundo", F.col("id_registro_fundo") + 900000000)
    bucketed.upsert_buckets(spark, table, renamed.unionByName(added), ["id_registro_fundo"])
    return spark.read.parquet(table).drop(f"balde_{BUCKETS}")


@register("bucketed_flow_join")
def _(spark, sf):
    """The flow ranking of tables that are bucketed by tax id."""
    suffix = uuid.uuid4().hex
    tables = [
        bucketed.save_bucketed(df, f"{name}_{suffix}", key, BUCKETS, scratch_path(spark, name))
        for name, df, key in (
            ("diaria_baldes", fx.daily(spark, sf), "cnpj_fundo_classe"), ("registro_baldes", fx.registry(spark, sf), "cnpj_fundo"),
        )
    ]
    return columns.serve(rankings.flow_ranking(*tables), zero=rankings.FLOW_AMOUNTS)


# Portfolio -------------------------------------------------------------------------------


def _portfolio_table(spark: SparkSession, sf: str) -> str:
    table, folder = scratch_path(spark, "composicao_carteira"), landed.portfolio_folder(spark, sf)
    loaders.load_portfolio(spark, folder, table)
    landed.discard(spark, folder)
    return table


@register("load_portfolio")
def _(spark, sf):
    positions = spark.read.parquet(_portfolio_table(spark, sf))
    return doubles(portfolio.unified_from_table(positions))


@register("block_views")
def _(spark, sf):
    """Rows and value per typed block view."""
    totals: DataFrame | None = None
    for name in views.block_views(spark, _portfolio_table(spark, sf)):
        rows = spark.table(name).agg(
            F.lit(name).alias("tabela"),
            F.count("*").alias("linhas"),
            F.sum("vl_merc_pos_final").cast("decimal(38,2)").alias("valor"),
        )
        totals = rows if totals is None else totals.unionByName(rows)
    return doubles(totals)


@register("stored_equity_exposure_latest")
def _(spark, sf):
    return doubles(rankings.equity_exposure_ranking(spark.read.parquet(_portfolio_table(spark, sf))))


@register("stored_equity_exposure_range")
def _(spark, sf):
    stored = spark.read.parquet(_portfolio_table(spark, sf))
    return doubles(rankings.equity_exposure_ranking(stored, "1996-01-01", "1997-12-31"))


@register("stored_equity_positions")
def _(spark, sf):
    stored = spark.read.parquet(_portfolio_table(spark, sf))
    rows = rankings.equity_positions(stored, "00000000000003", "CLASSES - FIF", start="1996-01-01")
    return doubles(rows.select("origem_tabela", "dt_comptc", "tp_ativo", "vl_merc_pos_final", "qt_pos_final"))


@register("stored_portfolio_composition")
def _(spark, sf):
    stored = spark.read.parquet(_portfolio_table(spark, sf))
    return portfolio.portfolio_composition(portfolio.unified_from_table(stored), stored=True)


# Quotes --------------------------------------------------------------------------------------


@register("load_quotes")
def _(spark, sf):
    """All fields; the day of the load and the files' names differ from run to run."""
    loaded = quotes.load_quotes(spark, landed.quote_folder(spark, sf))
    return loaded.drop("data_processamento", "arquivo_origem")


@register("load_quotes_zero_as_null")
def _(spark, sf):
    """Files in another encoding; zero prices as NULL."""
    folder = landed.quote_folder(spark, sf, "ISO-8859-1")
    loaded = quotes.load_quotes(spark, folder, "ISO-8859-1", zero_as_null=True)
    return loaded.select("codigo_negociacao", "nome_empresa", "preco_abertura", "variacao_percentual")


@register("classify_quote_lines")
def _(spark, sf):
    lines = fixed_width.read_lines(spark, landed.quote_folder(spark, sf))
    return fixed_width.classify_lines(lines).groupBy("situacao_linha").agg(F.count("*").alias("linhas"))


@register("rejected_quote_lines")
def _(spark, sf):
    lines = fixed_width.read_lines(spark, landed.quote_folder(spark, sf))
    rejected = fixed_width.rejected_lines(lines)
    return rejected.select(
        "situacao_linha", F.trim(F.substring("line", 13, 12)).alias("codigo_negociacao")
    )


# Delimited lines ----------------------------------------------------------------------------------


def _uneven_folder(spark: SparkSession, sf: str) -> str:
    """Supplier lines of which some have a field too few or too many."""
    key = F.col("s_suppkey").cast("string")
    line = (
        F.when(F.col("s_acctbal") > 6000, F.concat_ws(";", key, F.lit('"Ação; ""X"""')))
        .when(F.col("s_acctbal") > 2000, F.concat_ws(";", key, "s_name", key, key))
        .otherwise(F.concat_ws(";", key, "s_name", F.lit("1")))
    )
    lines = fx.table(spark, sf, "supplier").select(line.alias("ID;NOME;SALDO"))
    return landed.write_lines(lines, scratch_path(spark, "linhas"), "csv", header=True)


@register("skip_long_lines")
def _(spark, sf):
    paths = list_files(spark, _uneven_folder(spark, sf), "*.csv")
    rows = delimited.read_delimited(spark, paths, encoding="UTF-8")
    return rows.drop(*delimited.LINE_ORDER)


@register("report_long_lines")
def _(spark, sf):
    paths = list_files(spark, _uneven_folder(spark, sf), "*.csv")
    return delimited.reject_report(spark, paths, encoding="UTF-8").select("primeiro_campo")


# Derived tables -------------------------------------------------------------------------------------


def _silver(spark: SparkSession, sf: str, name: str) -> DataFrame:
    folder = scratch_path(spark, "prata")
    paths = loaders.refresh_silver(fx.daily(spark, sf), fx.registry(spark, sf), folder)
    return doubles(spark.read.parquet(paths[name]).drop("dt_criacao"))


@register("silver_manager_ranking")
def _(spark, sf):
    return _silver(spark, sf, "ranking_gestores")


@register("silver_flow_ranking")
def _(spark, sf):
    return columns.serve(_silver(spark, sf, "ranking_movimentacao"), zero=[
        "vl_total", "total_resgates", "total_aportes", "fluxo_liquido", "percentual_fluxo_liquido"])


@register("silver_refresh_incremental")
def _(spark, sf):
    """The flow ranking after a first load with wrong amounts on some days and a second that corrects them
    and brings the later days."""
    table, folder = scratch_path(spark, "informacao_diaria"), scratch_path(spark, "prata")
    old, new = upsert_frames(spark, sf)
    wrong = F.when(F.col("dt_comptc") >= OVERLAP, F.col("captc_dia") + 1).otherwise(F.col("captc_dia")).cast("decimal(17,2)")
    for loaded in (old.withColumn("captc_dia", wrong), new):
        parquet.upsert_table(spark, table, loaded, schemas.DAILY_KEYS, month_of="dt_comptc")
        stored = spark.read.parquet(table)
        paths = silver.refresh_silver_changed(spark, stored, fx.registry(spark, sf), folder, loaded.select(*schemas.DAILY_KEYS))
    ranking = doubles(spark.read.parquet(paths["ranking_movimentacao"]).drop("dt_criacao"))
    return columns.serve(ranking, zero=rankings.FLOW_AMOUNTS)


def _stored_page(spark: SparkSession, sf: str, period: str, number: int, size: int) -> DataFrame:
    paths = loaders.refresh_silver(fx.daily(spark, sf), fx.registry(spark, sf), scratch_path(spark, "prata"))
    stored = spark.read.parquet(paths["ranking_movimentacao"])
    return rankings.flow_ranking_page(stored, period, number, size)


@register("stored_flow_ranking_page_day")
def _(spark, sf):
    return _stored_page(spark, sf, "dia", 0, 25)


@register("stored_flow_ranking_page_31_days")
def _(spark, sf):
    return _stored_page(spark, sf, "31_dias", 2, 20)


@register("silver_dates")
def _(spark, sf):
    return _silver(spark, sf, "datas_informacao_diaria")


# Archives and streams -----------------------------------------------------------------------------------


@register("unzip_landing")
def _(spark, sf):
    return archives.unpack_archives(landed.archive_rows(spark, sf))


@register("unzip_and_load_daily")
def _(spark, sf):
    """The daily archives landed member by member and loaded."""
    out = scratch_path(spark, "descompactados")
    archives.land_members(spark, landed.daily_archives(spark, sf), out)
    return doubles(loaders.load_daily(spark, out, since=SINCE))


@register("log_tail_appended")
def _(spark, sf):
    """Half of the lines are there at the first run, the others are appended to the same files before
    the second; the third finds nothing new. Files are read in ranges."""
    folder, more = landed.appended_log_folder(spark, sf)
    out, checkpoint = scratch_path(spark, "logs-por-dia"), scratch_path(spark, "logs-posicao")
    for run in range(3):
        if run == 1:
            landed.append_logs(folder, more)
        logs.write_logs(tail.log_tail(spark, folder, range_bytes=TAIL_RANGE), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("mensagem")


@register("log_stream")
def _(spark, sf):
    """The log lines after two runs of the stream; the second finds nothing new."""
    folder, out = landed.log_folder(spark, sf), scratch_path(spark, "logs-por-dia")
    checkpoint = scratch_path(spark, "logs-posicao")
    for _run in range(2):
        logs.write_logs(logs.log_stream(spark, folder), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("mensagem")


@register("ingest_daily")
def _(spark, sf):
    table = scratch_path(spark, "informacao_diaria")
    incremental.ingest_daily(
        spark, landed.daily_stream_folder(spark, sf), table,
        scratch_path(spark, "posicao"), pattern="*.csv", files_per_batch=4,
    ).awaitTermination()
    return doubles(spark.read.parquet(table).drop(parquet.MONTH))


@register("ingest_daily_counters")
def _(spark, sf):
    """The counters that the stream's batches have left, summed up."""
    kept = scratch_path(spark, "contadores")
    incremental.ingest_daily(
        spark, landed.daily_folder(spark, sf), scratch_path(spark, "informacao_diaria"), scratch_path(spark, "posicao"),
        pattern="*.csv", counters=kept,
    ).awaitTermination()
    return spark.read.parquet(kept).agg(F.sum("lidas").alias("lidas"), F.sum("gravadas").alias("gravadas"))


@register("ingest_daily_both_layouts")
def _(spark, sf):
    """Files of the older and the current layout in one stream."""
    table = scratch_path(spark, "informacao_diaria")
    incremental.ingest_daily(
        spark, landed.daily_folder(spark, sf), table, scratch_path(spark, "posicao"), pattern="*.csv",
    ).awaitTermination()
    return doubles(spark.read.parquet(table).drop(parquet.MONTH))
