"""Tables in hash buckets, daily sketches and the counters of loads."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fundspark import fixtures as fx
from fundspark.operators import keys, sketches
from fundspark.plans import loaders, rankings
from fundspark.sinks import bucketed
from fundspark.sinks.counters import Counters


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_bucketed_tables_join_where_they_lie(spark, sf_dir, tmp_path, capsys, no_broadcast):
    daily = bucketed.save_bucketed(fx.daily(spark, sf_dir), "diaria_b", "cnpj_fundo_classe", 4, str(tmp_path / "d"))
    registry = bucketed.save_bucketed(fx.registry(spark, sf_dir), "registro_b", "cnpj_fundo", 4, str(tmp_path / "r"))
    flows = rankings.recent_flows(daily, registry)
    flows.explain()
    # The latest date is a subquery of its own; nothing else is exchanged.
    plan = capsys.readouterr().out.split("Subqueries")[0]
    assert "Join" in plan and "Bucketed: true" in plan
    assert "hashpartitioning" not in plan
    plain = rankings.recent_flows(fx.daily(spark, sf_dir), fx.registry(spark, sf_dir))
    assert sorted(map(str, flows.collect())) == sorted(map(str, plain.collect()))
    for name in ("diaria_b", "registro_b"):
        spark.sql(f"DROP TABLE {name}")


def written(path):
    return {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("columns", [None, ["v"]])
def test_upserts_rewrite_touched_buckets_only(spark, tmp_path, columns):
    draw, path = random.Random(1), str(tmp_path / "t")
    schema = "k bigint, c string, v int, w int"
    table = {}
    for step in range(4):
        size = 500 if step == 0 else draw.randrange(1, 6)
        source = {(draw.randrange(800), draw.choice("ab")): (step, draw.randrange(9)) for _ in range(size)}
        frame = spark.createDataFrame([(k, c, v, w) for (k, c), (v, w) in source.items()], schema)
        before = written(path)
        touched = bucketed.upsert_buckets(spark, path, frame, ["k", "c"], columns, buckets=32)
        for key, (v, w) in source.items():
            table[key] = (v, w) if columns is None or key not in table else (v, table[key][1])
        stored = spark.read.parquet(path).drop("balde_32")
        assert sorted(tuple(r) for r in stored.select("k", "c", "v", "w").collect()) == sorted((*k, *v) for k, v in table.items())
        changed = {d.rsplit("=", 1)[-1] for d, _ in before - written(path)}
        assert changed <= {str(b) for b in touched} and len(touched) <= size
    assert bucketed.upsert_buckets(spark, path, spark.createDataFrame([], schema), ["k", "c"]) == []
    with pytest.raises(ValueError):
        bucketed.upsert_buckets(spark, path, spark.createDataFrame([(1, "a", 1, 1)] * 2, schema), ["k", "c"])


def test_only_touched_buckets_are_read(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    bucketed.upsert_buckets(spark, path, spark.range(1000).withColumn("v", F.lit(1)), ["id"], buckets=16)
    table = spark.read.parquet(path)
    name = bucketed.bucket_column(table)
    keys.merge_upsert(table.filter(F.col(name).isin([3, 5])), table.limit(0), ["id", name]).explain()
    assert f"PartitionFilters: [{name}" in capsys.readouterr().out.replace("isnotnull(" + name, name)


def test_sketches_merge_to_any_range(spark):
    days = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 30).cast("int")).alias("dt_comptc"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 20_011).cast("string")).alias("a"), F.lit("x").alias("b"),
    )
    kept = sketches.daily_sketches(days, ["a", "b"])
    assert kept.count() == 30
    for start, end in ((None, None), ("2024-01-10", "2024-01-12"), ("2024-01-05", "2024-01-05")):
        rows = days
        rows = rows.filter(F.col("dt_comptc") >= start) if start else rows
        rows = rows.filter(F.col("dt_comptc") <= end) if end else rows
        exact, found = rows.select("a", "b").dropna().distinct().count(), sketches.distinct_from_sketches(kept, start, end).first()
        assert found.linhas == rows.count() and abs(found.distintos - exact) <= sketches.RELATIVE_ERROR * exact
    assert tuple(sketches.distinct_from_sketches(kept, "2030-01-01").first()) == (0, 0)


def test_loads_count_without_a_job_of_their_own(spark, sf_dir):
    from fundspark import landed
    from fundspark.session import scratch_path

    seen, folder = Counters(), landed.daily_folder(spark, sf_dir)
    table = loaders.load_daily(spark, folder, scratch_path(spark, "t"), counters=seen)
    assert seen.get() == {"lidas": 2 * fx.daily(spark, sf_dir).count() + fx.daily(spark, sf_dir).filter("id_subclasse = 'NA'").count(),
                          "gravadas": table.count()}


def test_incremental_silver_equals_a_full_refresh(spark, sf_dir, tmp_path):
    from fundspark import schemas
    from fundspark.plans.silver import refresh_silver_changed
    from fundspark.sinks import parquet

    table, registry = str(tmp_path / "t"), fx.registry(spark, sf_dir)
    daily = fx.daily(spark, sf_dir).filter("cnpj_fundo_classe < '00000000000030'")
    later = daily.withColumn("dt_comptc", F.date_add("dt_comptc", 40))
    emptied = later.withColumns({c: F.lit(None).cast("decimal(17,2)") for c in ("captc_dia", "resg_dia", "vl_patrim_liq")})
    some = daily.filter("dt_comptc < '2024-01-10'").withColumn("vl_patrim_liq", F.lit(5).cast("decimal(17,2)"))
    loads = [daily.filter("dt_comptc < '2024-01-20'"), daily, some, later, emptied, daily.limit(0)]
    paths = {}
    for loaded in loads:
        parquet.upsert_table(spark, table, loaded, schemas.DAILY_KEYS, month_of="dt_comptc")
        stored = spark.read.parquet(table)
        paths = refresh_silver_changed(spark, stored, registry, str(tmp_path / "a"), loaded.select(*schemas.DAILY_KEYS))
        full = loaders.refresh_silver(stored, registry, str(tmp_path / "b"))
        for name, path in full.items():
            ours, theirs = (sorted(map(str, spark.read.parquet(p).drop("dt_criacao").collect())) for p in (paths[name], path))
            assert ours == theirs, name
