"""Landed files in the published layouts, written by Spark from the test tables.

Each writer returns the folder (or file) a loader reads. Files published in parts
are folders named like the file.
"""

from __future__ import annotations

import functools
import io
import shutil
import zipfile
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark.functions.text import format_tax_id
from fundspark.schemas import BLOCKS, REGISTRATION, REGISTRATION_CHARS
from fundspark.session import remove, scratch_path, shuffles_dropped
from fundspark.sources.delimited import ENCODING, SEPARATOR
from fundspark.sources.stores import files_below, located

DAILY_HEADER = [
    "TP_FUNDO_CLASSE", "CNPJ_FUNDO_CLASSE", "ID_SUBCLASSE", "DT_COMPTC", "VL_TOTAL", "VL_QUOTA",
    "VL_PATRIM_LIQ", "CAPTC_DIA", "RESG_DIA", "NR_COTST",
]
CLASS_OFFSET = 500000000
ARCHIVE_ROWS = 500
ACCENT = " é"


#: Write each folder once per application, so that a benchmark can time the loads alone.
REUSE = False
_written: dict = {}


def _once(write: Callable) -> Callable:
    @functools.wraps(write)
    def run(spark: SparkSession, *args):
        key = (spark.sparkContext.applicationId, write.__name__, *args)
        if not REUSE or key not in _written:
            _written[key] = write(spark, *args)
        return _written[key]

    return run


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a landed folder once it is loaded, unless folders are written once and loaded again."""
    if not REUSE:
        for key in [key for key, path in _written.items() if path == folder]:
            del _written[key]
        remove(spark, folder)


def write_delimited(df: DataFrame, path: str, order: Sequence[str] = (), compression: str = "none") -> str:
    """Separated text with a header; ``order`` columns fix the line order and are dropped.

    Lines that tie in ``order`` are spread by their other columns."""
    if order:
        every = [*order, *[c for c in df.columns if c not in order]]
        df = df.repartitionByRange(*every).sortWithinPartitions(*every).drop(*order)
    (
        df.write.option("sep", SEPARATOR)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("compression", compression)
        .csv(path)
    )
    return path


def write_lines(
    lines: DataFrame, path: str, extension: str, encoding: str = "UTF-8", header: bool = False
) -> str:
    """The only column, one line per row, as ``*.<extension>`` files; its name is the
    first line of each file if ``header``."""
    (
        lines.write.option("extension", extension)
        .option("header", header)
        .option("encoding", encoding)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escapeQuotes", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )
    return path


def _daily_lines(daily: DataFrame, sequence: int) -> DataFrame:
    return daily.select(
        F.lit(sequence).alias("_seq"),
        F.col("tp_fundo_classe").alias("TP_FUNDO_CLASSE"),
        format_tax_id(F.col("cnpj_fundo_classe")).alias("CNPJ_FUNDO_CLASSE"),
        F.nullif("id_subclasse", F.lit("NA")).alias("ID_SUBCLASSE"),
        F.col("dt_comptc").cast("string").alias("DT_COMPTC"),
        *[F.col(n).cast("string").alias(n.upper()) for n in (
            "vl_total", "vl_quota", "vl_patrim_liq", "captc_dia", "resg_dia", "nr_cotst")],
    )


@_once
def daily_folder(spark: SparkSession, sf: str) -> str:
    """January in the current layout, each row after an outdated copy of itself, and
    December in the older layout."""
    folder = scratch_path(spark, "info-diaria")
    daily = fx.daily(spark, sf)
    stale = daily.withColumn("vl_quota", (F.col("vl_quota") + 7).cast("decimal(27,12)"))
    both = _daily_lines(stale, 0).unionByName(_daily_lines(daily, 1))
    write_delimited(both, f"{folder}/inf_diario_fi_202401.csv", ["_seq"])
    december = _daily_lines(
        daily.filter("id_subclasse = 'NA'").withColumn("dt_comptc", F.date_sub("dt_comptc", 31)), 0
    )
    older = december.drop("ID_SUBCLASSE", "_seq").withColumnsRenamed(
        {"TP_FUNDO_CLASSE": "TP_FUNDO", "CNPJ_FUNDO_CLASSE": "CNPJ_FUNDO"}
    )
    write_delimited(older, f"{folder}/inf_diario_fi_202312.csv")
    return folder


@_once
def damaged_daily_folder(spark: SparkSession, sf: str) -> str:
    """The daily rows in the current layout, some with amounts and dates that cannot be read."""
    folder = scratch_path(spark, "info-diaria-danificada")
    lines = _daily_lines(fx.daily(spark, sf), 0).drop("_seq")
    holders = F.col("NR_COTST").cast("int")
    damaged = lines.withColumns(
        {
            "VL_TOTAL": F.when(holders == 2, F.concat(F.col("VL_TOTAL"), F.lit("x"))).otherwise(F.col("VL_TOTAL")),
            "DT_COMPTC": F.when(holders == 3, "2024-13-01").otherwise(F.col("DT_COMPTC")),
            "RESG_DIA": F.when(F.col("RESG_DIA").isNotNull(), F.concat(F.lit("9" * 20), F.col("RESG_DIA"))),
        }
    )
    write_delimited(damaged, f"{folder}/inf_diario_fi_202401.csv")
    return folder


@_once
def daily_stream_folder(spark: SparkSession, sf: str) -> str:
    """The daily rows in the current layout, parts named for the stream's file pattern."""
    folder = scratch_path(spark, "info-diaria-stream")
    lines = _daily_lines(fx.daily(spark, sf), 0).drop("_seq").select(*DAILY_HEADER)
    write_delimited(lines, f"{folder}/inf_diario_fi_202401.csv")
    return f"{folder}/inf_diario_fi_202401.csv"


def _tax_id(column: str) -> Column:
    return format_tax_id(F.lpad(F.col(column).cast("string"), 14, "0"))


@_once
def registration_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    folder = scratch_path(spark, "info-cadastral")
    customers = fx.table(spark, sf, "customer")
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")

    def name(suffix: str) -> Column:
        return F.concat("c_name", F.lit(ACCENT + suffix))

    def other(column: str) -> Column:
        """What the further columns hold: ids, dates (some impossible), codes, a rate and texts."""
        if column.startswith("cnpj_"):
            value = _tax_id("c_nationkey")
        elif column.startswith("dt_"):
            value = F.when(balance > 3000, "2019-12-31").when(balance > 500, "2019-02-30").otherwise(" ")
        elif column in REGISTRATION_CHARS:
            value = F.when(segment == "BUILDING", " N ")
        elif column == "taxa_perfm":
            value = F.lit("2.25")
        elif column == "cd_cvm":
            value = F.col("c_custkey").cast("string")
        else:
            value = F.concat(F.lit(f"{column} "), segment)
        return value.alias(column.upper())

    named = {
        "cnpj_fundo", "denom_social", "cnpj_admin", "cpf_cnpj_gestor", "entid_invest", "pf_pj_gestor", "dt_reg",
        "trib_lprazo", "taxa_adm", "vl_patrim_liq",
    }
    others = [other(f.name) for f in REGISTRATION if f.name not in named]

    def current(sequence: int, suffix: str) -> DataFrame:
        return customers.filter(balance >= 0).select(
            *others,
            F.lit(sequence).alias("_seq"),
            _tax_id("c_custkey").alias("CNPJ_FUNDO"),
            name(suffix).alias("DENOM_SOCIAL"),
            _tax_id("c_nationkey").alias("CNPJ_ADMIN"),
            F.concat(F.lit("123.456.789-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("CPF_CNPJ_GESTOR"),
            F.when(segment == "BUILDING", " S ").when(segment == "MACHINERY", "SIM").alias("ENTID_INVEST"),
            F.lit("PJX").alias("PF_PJ_GESTOR"),
            F.when(balance > 5000, "2020-01-02").when(balance > 1000, "2024-99-01").alias("DT_REG"),
            F.lit("LONGO PRAZO").alias("TRIB_LPRAZO"),
            F.lit("1.5").alias("TAXA_ADM"),
            balance.cast("decimal(24,2)").cast("string").alias("VL_PATRIM_LIQ"),
        )

    def history(sequence: int, suffix: str) -> DataFrame:
        return customers.select(
            F.lit(sequence).alias("_seq"),
            _tax_id("c_custkey").alias("CNPJ_FUNDO"),
            name(suffix).alias("DENOM_SOCIAL"),
            F.lit("2001-01-01").alias("DT_INI_DENOM_SOCIAL"),
            F.lit("2002-01-01").alias("DT_FIM_DENOM_SOCIAL"),
            F.lit(" LONGO ").alias("TRIB_LPRAZO"),
        )

    return (
        write_delimited(
            current(0, "").unionByName(current(1, " tarde")), f"{folder}/info-cadastral.csv", ["_seq"]
        ),
        write_delimited(
            history(0, " antigo").unionByName(history(1, " novo")),
            f"{folder}/cad_fi_hist_denom_social.csv", ["_seq"],
        ),
    )


@_once
def registry_files(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    folder = scratch_path(spark, "registro")
    registry = fx.registry(spark, sf)

    def funds(sequence: int, suffix: str) -> DataFrame:
        return registry.select(
            F.lit(sequence).alias("_seq"),
            F.col("id_registro_fundo").alias("ID_Registro_Fundo"),
            format_tax_id(F.col("cnpj_fundo")).alias("CNPJ_Fundo"),
            F.concat("denominacao_social", F.lit(suffix)).alias("Denominacao_Social"),
            F.col("situacao").alias("Situacao"),
            F.col("cpf_cnpj_gestor").alias("CPF_CNPJ_Gestor"),
            F.col("gestor").alias("Gestor"),
            F.lit("2021-03-04").alias("Data_Registro"),
        )

    customers = fx.table(spark, sf, "customer")
    classes = customers.select(
        (F.col("c_custkey") + CLASS_OFFSET).alias("ID_Registro_Classe"),
        # Classes of customers in debt name a fund that is not registered.
        F.when(F.col("c_acctbal") < 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("ID_Registro_Fundo"),
        _tax_id("c_custkey").alias("CNPJ_Classe"),
        F.col("c_name").alias("Denominacao_Social"),
        F.lit("CDI").alias("Indicador_Desempenho"),
        F.lit("S").alias("Permitido_Aplicacao_CemPorCento_Exterior"),
        F.col("c_acctbal").cast("decimal(24,2)").alias("Patrimonio_Liquido"),
    )
    subclasses = fx.table(spark, sf, "orders").select(
        (F.col("o_custkey") + CLASS_OFFSET).alias("ID_Registro_Classe"),
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("ID_Subclasse"),
        F.col("o_orderkey").cast("string").alias("Codigo_CVM"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Data_Inicio"),
        F.lit("Subclasse").alias("Denominacao_Social"),
        F.lit("N").alias("Exclusivo"),
    )
    return (
        write_delimited(
            funds(0, " antes").unionByName(funds(1, "")), f"{folder}/registro_fundo.csv", ["_seq"]
        ),
        write_delimited(classes, f"{folder}/registro_classe.csv"),
        write_delimited(subclasses, f"{folder}/registro_subclasse.csv"),
    )


@_once
def portfolio_folder(spark: SparkSession, sf: str) -> str:
    """One file per block, in gzipped parts; the fund block uses the older column names.

    The positions are staged by block while the files are written, so that each reads its own rows only."""
    folder, kept = scratch_path(spark, "composicao-carteira"), scratch_path(spark, "posicoes")
    positions = fx.portfolio(spark, sf)
    with shuffles_dropped(spark):
        positions.write.partitionBy("tipo").parquet(kept)
    positions = spark.read.schema(positions.schema).parquet(kept)
    for block, (_, code, isin, _) in BLOCKS.items():
        rows = positions.filter(F.col("tipo") == block)
        columns = [
            format_tax_id(F.col("cnpj_fundo_classe")).alias("CNPJ_FUNDO" if block == 2 else "CNPJ_FUNDO_CLASSE"),
            F.col("tp_fundo_classe").alias("TP_FUNDO" if block == 2 else "TP_FUNDO_CLASSE"),
            F.col("dt_comptc").cast("string").alias("DT_COMPTC"),
            F.concat(F.lit("Fundo "), "cnpj_fundo_classe").alias("DENOM_SOCIAL"),
            F.col("tp_aplic").alias("TP_APLIC"),
            F.col("tp_ativo").alias("TP_ATIVO"),
            F.col("codigo_ativo").alias("CNPJ_FUNDO_COTA" if block == 2 else code.upper()),
            F.col("vl_merc_pos_final").cast("string").alias("VL_MERC_POS_FINAL"),
            F.col("qt_pos_final").cast("string").alias("QT_POS_FINAL"),
        ]
        if isin:
            columns.append(F.concat(F.lit("BR"), "codigo_ativo").alias(isin.upper()))
        write_delimited(rows.select(*columns), f"{folder}/cda_fi_BLC_{block}_202412.csv", compression="gzip")
    remove(spark, kept)
    return folder


def quote_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One fixed-width quote line per order, some unreadable, plus header, trailer and blank."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)

    def left(value: Column | str, width: int) -> Column:
        return F.rpad(F.lit(value) if isinstance(value, str) else value, width, " ")

    def number(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    unreadable = (priority == "1") & (status == "F")
    day = F.when(unreadable, "ABCDEFGH").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    opening = F.when(status == "P", F.lit(0)).otherwise(cents)
    line = F.concat(
        F.lit("01"), day, F.lit("02"), left(F.concat(F.lit("TK"), F.col("o_orderkey").cast("string")), 12),
        F.lit("010"), left("AÇÕES SA", 12), left("ON", 10), F.lit("   "), left("R$", 4),
        number(opening, 13), number(cents, 13), number(cents, 13), number(cents, 13),
        number(cents + F.col("o_custkey"), 13), F.lit(" " * 13), number(F.lit(0), 13),
        number(F.col("o_custkey") % 100000, 5),
        F.when(priority == "3", F.lit(" " * 18)).otherwise(number(F.col("o_custkey"), 18)),
        number(cents, 18), number(F.lit(0), 13), F.lit("0"),
        F.when(status == "O", F.lit("00000000")).otherwise(F.lit("20301231")),
        F.when(priority == "2", F.lit("0000000")).otherwise(F.lit("0001000")),
        number(F.lit(0), 13), left("BRTKACNOR000", 12), F.lit("123"),
    )
    short = (priority == "2") & (status == "F")
    lines = fx.table(spark, sf, "orders").select(
        F.when(short, F.substring(line, 1, 200)).otherwise(line).alias("line")
    )
    extra = spark.createDataFrame(
        [("00COTAHIST.2025".ljust(245),), ("99COTAHIST.2025".ljust(245),), (" ",)], "line string"
    )
    return lines.unionByName(extra)


@_once
def quote_folder(spark: SparkSession, sf: str, encoding: str = "UTF-8") -> str:
    return write_lines(quote_lines(spark, sf), scratch_path(spark, "cotacoes"), "txt", encoding)


def archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(archive, content)``: ZIP archives with the customers, 500 to an archive."""
    customers = fx.table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / ARCHIVE_ROWS).alias("parte"), "c_custkey", "c_name"
    )

    def zipped(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        lines = "".join(f"{k};{n}{ACCENT}\r\n" for k, n in zip(rows["c_custkey"], rows["c_name"]))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as bundle:
            bundle.writestr("dados/clientes.csv", lines.encode("latin-1"))
            bundle.writestr("leiame.txt", "nada")
        name = f"clientes_{rows['parte'].iloc[0]}.zip"
        return pd.DataFrame({"archive": [name], "content": [buffer.getvalue()]})

    # At most ARCHIVE_ROWS rows per group: c_custkey is unique.
    return customers.groupBy("parte").applyInPandas(zipped, "archive string, content binary")


@_once
def log_folder(spark: SparkSession, sf: str) -> str:
    """Nested ``*.log`` files with one line per event, and a file the stream ignores."""
    folder = scratch_path(spark, "logs")
    lines = fx.table(spark, sf, "events").select(
        F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("line")
    )
    write_lines(lines, f"{folder}/app/servico", "log")
    write_lines(lines, f"{folder}/app/outros", "txt")
    return folder


def appended_log_folder(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Log files with the older half of the events, and files with the other half to be appended to them."""
    root = scratch_path(spark, "logs-crescentes")
    lines = fx.table(spark, sf, "events").select(
        "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("line")
    )
    for name, rest in (("logs", 0), ("novas", 1)):
        write_lines(lines.filter(F.col("event_id") % 2 == rest).select("line"), f"{root}/{name}", "log")
    return f"{root}/logs", f"{root}/novas"


def append_logs(folder: str, more: str) -> None:
    """Append each file below ``more`` to one below ``folder``, as a program that logs would."""
    targets = [i.path for i in files_below(folder, ".log")]
    for i, info in enumerate(files_below(more, ".log")):
        with open(info.path, "rb") as source, open(targets[i % len(targets)], "ab") as target:
            shutil.copyfileobj(source, target)


@_once
def daily_archives(spark: SparkSession, sf: str) -> str:
    """The daily files in ZIP archives, one per month, as single members."""
    folder, zips = daily_folder(spark, sf), scratch_path(spark, "info-diaria-zip")
    store, root = located(zips)
    store.create_dir(root, recursive=True)
    for month in ("202312", "202401"):
        name = f"inf_diario_fi_{month}.csv"
        with zipfile.ZipFile(f"{root}/inf_diario_fi_{month}.zip", "w", zipfile.ZIP_DEFLATED) as bundle:
            with bundle.open(f"dados/{name}", "w", force_zip64=True) as member:
                for i, info in enumerate(files_below(f"{folder}/{name}", ".csv")):
                    with open(info.path, "rb") as part:
                        header = part.readline()
                        member.write(b"" if i else header)
                        shutil.copyfileobj(part, member)
    return zips
