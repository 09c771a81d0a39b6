"""What reaches the scan when the queries run on stored tables."""

import pytest
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark.operators import filters
from fundspark.plans import rankings, returns
from fundspark.sinks import parquet
from fundspark.sources.tables import read_table


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The daily rows spread over three months, partitioned by month."""
    path = str(tmp_path_factory.mktemp("stored") / "daily")
    daily = fx.daily(spark, sf_dir)
    months = daily.withColumn("dt_comptc", F.add_months("dt_comptc", F.col("nr_cotst") % 3))
    parquet.refresh_partitions(parquet.with_month(months), path, [parquet.MONTH])
    return path


def plan(capsys, df):
    df.explain()
    return capsys.readouterr().out


def test_predicate_and_columns_reach_the_scan(spark, capsys, stored):
    df = read_table(spark, stored, ["dt_comptc", "vl_total"], F.col("cnpj_fundo_classe") == "00000000000003")
    text = plan(capsys, df)
    assert "EqualTo(cnpj_fundo_classe,00000000000003)" in text and "vl_quota" not in text


def test_id_lists_reach_the_scan(spark, capsys, stored, sf_dir):
    ids = ["00000000000003", "00000000000007"]
    text = plan(capsys, returns.quota_series(spark.read.parquet(stored), fx.registry(spark, sf_dir), ids))
    assert "In(cnpj_fundo_classe" in text


def test_rankings_read_only_their_columns(spark, capsys, stored, sf_dir):
    daily = spark.read.parquet(stored)
    schema = plan(capsys, rankings.manager_aum_active(daily, fx.registry(spark, sf_dir)))
    assert "vl_quota" not in schema and "captc_dia" not in schema


def test_date_ranges_prune_months(spark, rows, capsys, stored):
    daily = spark.read.parquet(stored)
    ranged = filters.date_range(daily, "2024-02-10", "2024-02-20")
    assert {f.split("ym=")[1][:6] for f in ranged.inputFiles()} >= {"202402"}
    text = plan(capsys, ranged)
    assert "PartitionFilters: [isnotnull(ym" in text and "202402" in text
    plain = daily.drop("ym")
    assert rows(ranged.drop("ym")) == rows(filters.date_range(plain, "2024-02-10", "2024-02-20"))


@pytest.mark.parametrize("period", ["dia", "7_dias", "31_dias"])
def test_trailing_periods_prune_months(spark, rows, capsys, stored, period):
    daily = spark.read.parquet(stored)
    trailing = filters.trailing_period(daily, period)
    assert rows(trailing.drop("ym")) == rows(filters.trailing_period(daily.drop("ym"), period))
    scans = [line for line in plan(capsys, trailing).splitlines() if "FileScan" in line]
    assert all("PartitionFilters: [isnotnull(ym" in line or "struct<>" in line for line in scans)


def test_flow_ranking_of_a_stored_table(spark, rows, stored, sf_dir):
    daily, registry = spark.read.parquet(stored), fx.registry(spark, sf_dir)
    assert rows(rankings.flow_ranking(daily, registry)) == rows(rankings.flow_ranking(daily.drop("ym"), registry))


def test_portfolio_dates_prune_months(spark, capsys, sf_dir):
    from fundspark import landed
    from fundspark.plans import loaders
    from fundspark.session import scratch_path

    table = scratch_path(spark, "positions")
    stored = loaders.load_portfolio(spark, landed.portfolio_folder(spark, sf_dir), table)
    assert dict(stored.dtypes)["ym"] == "string" and dict(stored.dtypes)["ym_arquivo"] == "string"
    text = plan(capsys, filters.date_range(stored, "1996-01-01", "1996-03-31"))
    assert "PartitionFilters: [isnotnull(ym" in text and "199601" in text


def test_dates_come_from_footers(spark, capsys, stored):
    from fundspark.sources.tables import stored_latest_date, stored_month_ranges

    latest = stored_latest_date(spark, stored)
    text = plan(capsys, latest)
    assert "PushedAggregation: [MAX(dt_comptc)]" in text and "ym" in text.split("PartitionFilters")[1]
    table = spark.read.parquet(stored)
    assert latest.first()[0] == table.agg(F.max("dt_comptc")).first()[0]
    ranges = stored_month_ranges(spark, stored)
    text = plan(capsys, ranges)
    assert "PushedAggregation: [MIN(dt_comptc), MAX(dt_comptc), COUNT(dt_comptc)]" in text and "PushedGroupBy: [ym]" in text
    expected = table.groupBy("ym").agg(F.min("dt_comptc"), F.max("dt_comptc"), F.count("*"))
    assert sorted(ranges.collect()) == sorted(expected.collect())
    assert "FileScan" in plan(capsys, table.agg(F.max("dt_comptc")))  # other frames keep their reader
