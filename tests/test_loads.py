"""Loaders, sources and streams on hand-made files."""

import datetime as dt
import gzip
import os
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundspark import landed, schemas
from fundspark.plans import landing, loaders, quotes
from fundspark.registered import loads as registered_loads
from fundspark.session import scratch_root
from fundspark.sinks import parquet
from fundspark.sources import delimited, fixed_width
from fundspark.sources.files import daily_files, month_start, portfolio_files
from fundspark.streaming import incremental, logs

HEADER = ";".join(landed.DAILY_HEADER)
OLD_HEADER = "TP_FUNDO;CNPJ_FUNDO;DT_COMPTC;VL_TOTAL;VL_QUOTA;VL_PATRIM_LIQ;CAPTC_DIA;RESG_DIA;NR_COTST"


def write(path, *lines, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def daily_line(cnpj, day, quota, subclass=""):
    return f"FI;{cnpj};{subclass};{day};100.00;{quota};90.00;1.00;;5"


# Delimited files ---------------------------------------------------------------------


def test_short_lines_are_padded_and_long_lines_skipped(spark, rows, tmp_path):
    path = write(tmp_path / "f.csv", "A;B;C", "1;2;3", "4;5", "6;7;8;9", '"x;y";é;"q""r"')
    df = delimited.read_delimited(spark, [path]).drop(*delimited.LINE_ORDER)
    assert rows(df) == [("1", "2", "3"), ("4", "5", None), ("x;y", "é", 'q"r')]
    assert rows(delimited.reject_report(spark, [path]), "linha") == [("6;7;8;9",)]
    assert delimited.read_delimited(spark, [path]).count() == 3


def test_long_lines_can_fail_the_job(spark, tmp_path):
    path = write(tmp_path / "f.csv", "A;B", "1;2;3")
    with pytest.raises(Exception, match="too many fields"):
        delimited.read_delimited(spark, [path], bad_lines="fail").collect()


def test_a_file_that_breaks_its_group_layout_fails(spark, tmp_path):
    paths = [write(tmp_path / "a.csv", "A;B", "1;2"), write(tmp_path / "b.csv", "B;A", "1;2")]
    mixed = delimited.read_delimited(spark, paths)
    assert sorted(r.a for r in mixed.collect()) == ["1", "2"]
    with pytest.raises(Exception):
        delimited.read_delimited(spark, paths, alike=lambda p: 0).collect()


def test_no_input(spark):
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, [])


# Discovery ------------------------------------------------------------------------------


def test_daily_discovery(spark, tmp_path):
    for month in ("202502", "202503", "202504"):
        write(tmp_path / f"inf_diario_fi_{month}.csv", HEADER)
    write(tmp_path / "other.csv", "A")
    folder = str(tmp_path)
    assert [f.month for f in daily_files(spark, folder)] == ["202502", "202503", "202504"]
    assert [f.month for f in daily_files(spark, folder, latest_only=True)] == ["202504"]
    assert [f.month for f in daily_files(spark, folder, since="202503")] == ["202503", "202504"]
    with pytest.raises(FileNotFoundError):
        daily_files(spark, folder, since="202505")
    assert month_start("202504") == dt.date(2025, 4, 1)


def test_portfolio_discovery_is_newest_first(spark, tmp_path):
    for name in ("cda_fi_BLC_2_202401", "cda_fi_BLC_1_202402", "cda_fi_BLC_1_202401", "cda_fi_PL_202401"):
        write(tmp_path / f"{name}.csv", "A")
    found = [(f.month, f.block) for f in portfolio_files(spark, str(tmp_path))]
    assert found == [("202402", 1), ("202401", 1), ("202401", 2)]


# Daily load --------------------------------------------------------------------------------


def test_daily_load_last_line_wins_within_and_across_files(spark, rows, tmp_path):
    write(
        tmp_path / "inf_diario_fi_202503.csv", HEADER,
        daily_line("00.000.000/0001-91", "2025-03-31", "1.5"), daily_line("00.000.000/0001-91", "2025-03-31", "2.5"),
    )
    write(
        tmp_path / "inf_diario_fi_202504.csv", HEADER,
        daily_line("191", "2025-03-31", "3.5"), daily_line("191", "2025-04-01", "4.5", "S1"),
        daily_line("191", "2025-04-01", "5.5", "S1"), daily_line("191", "2025-04-01", "6.5", "S1"),
    )
    loaded = loaders.load_daily(spark, str(tmp_path))
    assert rows(loaded, "cnpj_fundo_classe", "dt_comptc", "id_subclasse", "vl_quota") == [
        ("00000000000191", dt.date(2025, 3, 31), "NA", Decimal("3.5")),
        ("00000000000191", dt.date(2025, 4, 1), "S1", Decimal("6.5")),
    ]
    assert loaded.schema.fieldNames() == schemas.DAILY.fieldNames()


def test_daily_load_of_both_layouts_into_a_table(spark, rows, tmp_path):
    table = str(tmp_path / "out")
    old = write(tmp_path / "in" / "inf_diario_fi_202503.csv", OLD_HEADER, "FI;191;2025-03-31;1;2;3;4;5;6")
    loaders.load_daily(spark, str(tmp_path / "in"), table)
    write(tmp_path / "in" / "inf_diario_fi_202504.csv", HEADER, daily_line("191", "2025-03-31", "9"),
          daily_line("191", "2025-04-01", "8"))
    stored = loaders.load_daily(spark, str(tmp_path / "in"), table)
    assert old and rows(stored, "dt_comptc", "vl_quota", "resg_dia") == [
        (dt.date(2025, 3, 31), Decimal("9"), None), (dt.date(2025, 4, 1), Decimal("8"), None),
    ]


def test_last_line_wins_in_a_split_file(spark, tmp_path):
    lines = [daily_line("191", "2025-04-01", str(n)) for n in range(20_000)]
    write(tmp_path / "inf_diario_fi_202504.csv", HEADER, *lines)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        loaded = loaders.load_daily(spark, str(tmp_path))
        assert [r.vl_quota for r in loaded.collect()] == [Decimal(19_999)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


# Registration and registry --------------------------------------------------------------------


def test_registration_first_current_line_and_last_history_line(spark, rows, tmp_path):
    current = write(
        tmp_path / "info-cadastral.csv", "CNPJ_FUNDO;DENOM_SOCIAL;DT_REG;ENTID_INVEST;TRIB_LPRAZO",
        "00.000.000/0001-91;Fundo Á;2024-99-01; SIM;LONGO", "191;Outro;2024-01-01;N;LONGO",
    )
    history = write(
        tmp_path / "cad_fi_hist_denom_social.csv",
        "CNPJ_FUNDO;DENOM_SOCIAL;DT_INI_DENOM_SOCIAL;DT_FIM_DENOM_SOCIAL;TRIB_LPRAZO",
        "191;Velho;x;x;LONGO", "272;Primeiro;x;x;LONGO", "272;" + "N" * 600 + ";x;x; ", "272;a;b;c;d;e",
    )
    loaded = loaders.load_registration(spark, current, history)
    assert rows(loaded, "cnpj_fundo", "denom_social", "dt_reg", "entid_invest", "trib_lprazo") == [
        ("00000000000191", "Fundo Á", dt.date(1900, 1, 1), "S", "LONGO"),
        ("00000000000272", "N" * 500, None, None, None),
    ]


def registry_paths(tmp_path, class_of_subclass):
    return (
        write(tmp_path / "registro_fundo.csv", "ID_Registro_Fundo;CNPJ_Fundo;Denominacao_Social",
              "1;191;Antes", "1;191;Depois"),
        write(tmp_path / "registro_classe.csv", "ID_Registro_Classe;ID_Registro_Fundo;Indicador_Desempenho",
              "10;1;CDI", "11;1;CDI", "12;9;CDI"),
        write(tmp_path / "registro_subclasse.csv", "ID_Registro_Classe;ID_Subclasse;Situacao",
              f"{class_of_subclass};S1;Situacao {class_of_subclass}", "12;S2;Sem pai"),
    )


def test_registry_needs_parents_and_keeps_a_subclass_in_its_class(spark, rows, tmp_path):
    tables = tuple(str(tmp_path / t) for t in ("funds", "classes", "subclasses"))
    loaders.load_registry(spark, *registry_paths(tmp_path / "a", 10), tables)
    stored = loaders.load_registry(spark, *registry_paths(tmp_path / "b", 11), tables)
    assert rows(stored.funds, "id_registro_fundo", "denominacao_social") == [(1, "Depois")]
    assert rows(stored.classes, "id_registro_classe", "identificador_desempenho") == [(10, "CDI"), (11, "CDI")]
    assert rows(stored.subclasses, "id_subclasse", "id_registro_classe", "situacao") == [("S1", 10, "Situacao 11")]


def test_registry_without_tables(spark, rows, tmp_path):
    loaded = loaders.load_registry(spark, *registry_paths(tmp_path, 10))
    assert rows(loaded.subclasses, "id_subclasse") == [("S1",)]


# Portfolio ----------------------------------------------------------------------------------------


def test_portfolio_load_and_missing_input(spark, rows, tmp_path):
    write(tmp_path / "in" / "cda_fi_BLC_1_202401.csv",
          "TP_FUNDO_CLASSE;CNPJ_FUNDO_CLASSE;DT_COMPTC;CD_SELIC;CD_ISIN;VL_MERC_POS_FINAL",
          "FI;00.000.000/0001-91;2024-01-31;210100;BR1;10.50", "FI;191;2024-01-31;1;2;3;4")
    write(tmp_path / "in" / "cda_fi_BLC_2_202312.csv",
          "TP_FUNDO;CNPJ_FUNDO;DT_COMPTC;CNPJ_FUNDO_COTA;VL_MERC_POS_FINAL", "FI;191;2023-12-31;00.000.000/0002-72;7")
    table = str(tmp_path / "out")
    stored = loaders.load_portfolio(spark, str(tmp_path / "in"), table)
    assert rows(stored, "origem_tabela", "ym_arquivo", "cnpj_fundo_classe", "vl_merc_pos_final", "cnpj_fundo_classe_cota") == [
        ("FUNDOS", "202312", "00000000000191", Decimal("7"), "00000000000272"),
        ("TITULO_PUBLICO_SELIC", "202401", "00000000000191", Decimal("10.50"), None),
    ]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        loaders.load_portfolio(spark, str(tmp_path / "empty"), table)
    assert spark.read.parquet(table).count() == 2


# Quotes -----------------------------------------------------------------------------------------------


def quote(**fields):
    line = [" "] * 245
    values = {"data_pregao": "20250102", "data_vencimento": "00000000", "preco_abertura": "0000000001000",
              "preco_ultimo": "0000000001250", **fields}
    for field in fixed_width.QUOTE_FIELDS:
        text = values.get(field.name, "")
        line[field.start:field.start + len(text)] = text
    return "01" + "".join(line)[2:]


def test_quote_lines(spark, rows, tmp_path):
    path = write(
        tmp_path / "cotahist.txt", "00COTAHIST.2025".ljust(245), " ", quote(codigo_negociacao="OK"),
        quote(codigo_negociacao="ZERO", preco_abertura="0" * 13), quote(codigo_negociacao="BAD", data_pregao="20251345"),
        quote(codigo_negociacao="L244")[:244], quote(codigo_negociacao="L243")[:243],
        quote(codigo_negociacao="QTY", quantidade_titulos=" " * 18, fator_cotacao="0000000"),
        quote(codigo_negociacao="NAN", numero_negocios="12x"), "99COTAHIST".ljust(245), encoding="utf-8",
    )
    loaded = quotes.load_quotes(spark, path)
    assert rows(loaded, "codigo_negociacao", "preco_abertura", "variacao_percentual", "quantidade_titulos", "fator_cotacao") == [
        ("L244", 10.0, 25.0, 0, 1), ("OK", 10.0, 25.0, 0, 1), ("QTY", 10.0, 25.0, 0, 1), ("ZERO", 0.0, None, 0, 1),
    ]
    first = loaded.first()
    assert first.arquivo_origem == "cotahist.txt" and first.data_processamento and first.data_vencimento is None
    assert first.preco_maximo is None
    states = fixed_width.classify_lines(fixed_width.read_lines(spark, path)).groupBy("situacao_linha").count()
    assert rows(states) == [("cabecalho", 1), ("curta", 1), ("ilegivel", 3), ("valida", 4), ("vazia", 1)]


def test_quote_bytes_that_are_not_utf8_fail(spark, tmp_path):
    path = write(tmp_path / "q.txt", quote(nome_empresa="AÇÃO"), encoding="latin-1")
    with pytest.raises(Exception, match="UTF"):
        quotes.load_quotes(spark, path).collect()
    assert quotes.load_quotes(spark, path, encoding="ISO-8859-1").first().nome_empresa == "AÇÃO"


# Archives and streams ---------------------------------------------------------------------------------


def test_unzip(spark, rows, tmp_path):
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "a.zip", "w") as bundle:
        bundle.writestr("x/one.csv", "A;B\r\n1;é\r\n".encode("latin-1"))
        bundle.writestr("skip.txt", "no")
    lines = landing.unzip_landing(spark, str(tmp_path / "zips"))
    assert rows(lines) == [("a.zip", "one.csv", 0, "A;B"), ("a.zip", "one.csv", 1, "1;é")]
    landing.unzip_landing(spark, str(tmp_path / "zips"), str(tmp_path / "out"))
    part = next((tmp_path / "out" / "a.zip" / "x" / "one.csv").glob("*.csv"))
    assert part.read_bytes().decode("latin-1").splitlines() == ["A;B", "1;é"]


def test_log_stream_reads_each_line_once(spark, rows, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("logs", "out", "checkpoint"))

    def run():
        logs.write_logs(logs.log_stream(spark, folder), out, checkpoint).awaitTermination()
        return rows(spark.read.parquet(out), "mensagem", "arquivo")

    write(tmp_path / "logs" / "a" / "x.log", "um", "dois")
    write(tmp_path / "logs" / "a" / "x.txt", "não")
    assert run() == [("dois", "x.log"), ("um", "x.log")]
    write(tmp_path / "logs" / "y.log", "três", encoding="utf-8")
    assert run() == [("dois", "x.log"), ("três", "y.log"), ("um", "x.log")]
    days = spark.read.parquet(out).select("dia").distinct().collect()
    assert all(len(r.dia) == 10 and r.dia[4] == "." for r in days)


def test_stream_equals_batch_and_restarts_clean(spark, rows, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        incremental.ingest_daily(spark, folder, table, checkpoint, files_per_batch=1).awaitTermination()
        return rows(spark.read.parquet(table), *schemas.DAILY.fieldNames())

    write(tmp_path / "in" / "inf_diario_fi_202503.csv", HEADER, daily_line("191", "2025-03-31", "1"),
          daily_line("191", "2025-03-31", "2"))
    first = run()
    assert first == run() and len(first) == 1
    write(tmp_path / "in" / "inf_diario_fi_202504.csv", HEADER, daily_line("191", "2025-03-31", "3"),
          daily_line("191", "2025-04-01", "4"))
    batch = loaders.load_daily(spark, folder)
    assert run() == rows(batch, *schemas.DAILY.fieldNames())


def test_stream_fails_on_a_long_line(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    write(tmp_path / "in" / "inf_diario_fi_202503.csv", HEADER, daily_line("191", "2025-03-31", "1") + ";x")
    query = incremental.ingest_daily(spark, folder, table, checkpoint)
    with pytest.raises(Exception, match="too many fields"):
        query.awaitTermination()


# Losses and broken writes ----------------------------------------------------------------------


def test_unreadable_values_fail_the_load(spark, tmp_path):
    write(tmp_path / "inf_diario_fi_202503.csv", HEADER, daily_line("191", "2025-03-31", "12,5"))
    with pytest.raises(Exception, match="vl_quota cannot hold 12,5"):
        loaders.load_daily(spark, str(tmp_path)).collect()
    assert loaders.load_daily(spark, str(tmp_path), on_loss="null").first().vl_quota is None


def test_a_failed_upsert_loses_nothing_and_can_be_repeated(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    from fundspark.sinks import parquet

    table = str(tmp_path / "t")
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    parquet.upsert_table(spark, table, stored, ["id"])
    source = spark.createDataFrame([(3, "c")], "id int, v string")
    broken = source.withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        parquet.refresh(spark.read.parquet(table).unionByName(broken), table)
    assert rows(spark.read.parquet(table)) == [(1, "a"), (2, "b")]
    parquet.upsert_table(spark, table, source, ["id"])
    assert rows(spark.read.parquet(table)) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_version_set_aside_is_put_back(spark, tmp_path):
    from fundspark.sources.tables import OLD, path_has_data

    table = tmp_path / "t"
    assert not path_has_data(spark, str(table))
    spark.range(3).write.parquet(str(table) + OLD)
    assert path_has_data(spark, str(table)) and spark.read.parquet(str(table)).count() == 3


def test_unzipped_files_can_be_loaded(spark, rows, tmp_path):
    import zipfile

    from fundspark.plans.landing import unzip_landing

    (tmp_path / "zip").mkdir()
    lines = "\r\n".join([HEADER, daily_line("191", "2025-03-31", "1.5"), daily_line("191", "2025-03-31", "2.5"), ""])
    for month, folder in (("202503", "a/"), ("202504", "")):
        with zipfile.ZipFile(tmp_path / "zip" / f"d{month}.zip", "w") as bundle:
            bundle.writestr(f"{folder}inf_diario_fi_{month}.csv", lines.replace("2025-03-31", f"2025-{month[4:]}-30").encode("latin-1"))
            bundle.writestr("b/note.csv", "ação".encode("latin-1"))
    out = str(tmp_path / "landed")
    unzip_landing(spark, str(tmp_path / "zip"), out)
    loaded = loaders.load_daily(spark, out)
    assert rows(loaded, "dt_comptc", "vl_quota") == [
        (dt.date(2025, 3, 30), Decimal("2.5")), (dt.date(2025, 4, 30), Decimal("2.5")),
    ]
    note = next((tmp_path / "landed" / "d202503.zip" / "b" / "note.csv").glob("*.csv"))
    assert note.read_bytes().decode("latin-1").strip() == "ação"


def test_positions_are_shuffled_and_sorted_without_the_other_blocks_columns(spark, sf_dir, tmp_path, monkeypatch):
    """Only what the files hold is dealt to the partitions and sorted, once; the table has all columns."""
    seen = []

    def keep(df, path, partition_by, balance=True, real=parquet.refresh_partitions):
        seen.append((df, balance))
        real(df, path, partition_by, balance)

    monkeypatch.setattr(parquet, "refresh_partitions", keep)
    table = str(tmp_path / "posicoes")
    loaded = loaders.load_portfolio(spark, landed.portfolio_folder(spark, sf_dir), table)
    (written, balance), = seen
    plan = written._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Sort":
        plan = plan.children().head()
    assert plan.output().size() < 30 < len(written.columns) and not balance
    assert set(loaded.columns) == {*loaders.positions_schema().fieldNames(), parquet.MONTH}


def test_a_dealt_null_lands_in_its_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, ym string")
    parquet.refresh_partitions(parquet.dealt(df, ["ym"]), str(tmp_path / "t"), ["ym"], balance=False)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a"), (2, None)]
    assert (tmp_path / "t" / "ym=__HIVE_DEFAULT_PARTITION__").is_dir()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_stored_portfolio_leaves_only_its_table(spark, tmp_path):
    """Neither shuffle files nor staged positions nor landed files lie beside the table that the stored queries read."""
    lines = spark.range(200).select(
        *[F.col("id").alias(c) for c in ("l_orderkey", "l_suppkey", "l_partkey")],
        F.lit("2024-01-05 00:00:00").cast("timestamp").alias("l_shipdate"), F.lit("A").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        F.lit(3.0).alias("l_extendedprice"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    root = scratch_root(spark).removeprefix("file:")
    shuffled, staged = shuffle_files(spark), set(os.listdir(root)) if os.path.isdir(root) else set()
    table = registered_loads._portfolio_table(spark, str(tmp_path))
    assert shuffle_files(spark) <= shuffled
    assert set(os.listdir(root)) - staged == {os.path.basename(table)}
    assert spark.read.parquet(table).count() == 200


def test_landed_folders_written_once_are_kept(spark, tmp_path, monkeypatch):
    (tmp_path / "kept").mkdir()
    monkeypatch.setattr(landed, "REUSE", True)
    landed.discard(spark, str(tmp_path / "kept"))
    assert (tmp_path / "kept").is_dir()


def test_gzipped_block_files(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    text = "TP_FUNDO_CLASSE;CNPJ_FUNDO_CLASSE;DT_COMPTC;CD_SWAP;DENOM_SOCIAL\nFI;191;2024-01-31;9;Ação\n"
    with gzip.open(tmp_path / "in" / "cda_fi_BLC_3_202401.csv.gz", "wb") as file:
        file.write(text.encode("latin-1"))
    write(tmp_path / "in" / "cda_fi_BLC_3_202402.csv", text.replace("01-31", "02-29").strip())
    loaded = loaders.load_portfolio(spark, str(tmp_path / "in"))
    assert rows(loaded, "ym_arquivo", "cnpj_fundo_classe", "dt_comptc", "cd_swap", "denom_social") == [
        ("202401", "00000000000191", dt.date(2024, 1, 31), "9", "Ação"),
        ("202402", "00000000000191", dt.date(2024, 2, 29), "9", "Ação"),
    ]
