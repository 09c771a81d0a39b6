"""Frame operators: keys, upsert, ranks, filters, paging, conform."""

import datetime as dt
from decimal import Decimal

import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundspark import schemas
from fundspark.operators import aggregates, columns, filters, keys, paging, ranking
from fundspark.sinks import counters, parquet, views


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "table")


# Dedup and duplicates ---------------------------------------------------------------


def test_dedup_keeps_first_or_last_and_joins_null_keys(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 1, "p"), (None, 2, None)], "k string, n int, v string"
    )
    assert rows(keys.dedup_keep(df, ["k"], ["n"])) == [(None, 2, None), ("a", 3, "z")]
    assert rows(keys.dedup_keep(df, ["k"], ["n"], keep="first")) == [(None, 1, "p"), ("a", 1, "x")]


def test_dedup_of_key_columns_only(spark, rows):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(keys.dedup_keep(df, ["k"], ["k"])) == [("a",)]


def test_duplicate_report_includes_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(keys.duplicate_report(df, ["k"])) == [(None, 4, 2), (None, 5, 2), ("b", 2, 2), ("b", 3, 2)]
    assert rows(keys.dedup_counters(df, ["k"])) == [(5, 3, 2)]


def test_dedup_counters_of_nothing(spark, rows):
    assert rows(keys.dedup_counters(spark.createDataFrame([], "k string"), ["k"])) == [(0, 0, 0)]


# Upsert --------------------------------------------------------------------------------


TARGET = [("a", 1, "old"), ("b", 2, "old")]
SOURCE = [("b", None, "new"), ("c", 3, "new")]


def frames(spark):
    kind = "k string, n int, v string"
    return spark.createDataFrame(TARGET, kind), spark.createDataFrame(SOURCE, kind)


def test_upsert_overwrites_with_null(spark, rows):
    target, source = frames(spark)
    assert rows(keys.merge_upsert(target, source, ["k"])) == [("a", 1, "old"), ("b", None, "new"), ("c", 3, "new")]


def test_upsert_leaves_unlisted_columns(spark, rows):
    target, source = frames(spark)
    merged = keys.merge_upsert(target, source, ["k"], ["n"])
    assert rows(merged) == [("a", 1, "old"), ("b", None, "old"), ("c", 3, "new")]


def test_upsert_matches_columns_by_name(spark, rows):
    target, source = frames(spark)
    merged = keys.merge_upsert(target, source.select("v", "k", "n"), ["k"])
    assert ("c", 3, "new") in rows(merged)


def test_duplicate_source_key_fails(spark, table):
    _, source = frames(spark)
    with pytest.raises(ValueError, match="duplicate or missing key"):
        parquet.upsert_table(spark, table, source.unionByName(source), ["k"])


def test_missing_source_key_fails(spark, table):
    source = spark.createDataFrame([(None, 1)], "k string, n int")
    with pytest.raises(ValueError, match="duplicate or missing key"):
        parquet.upsert_table(spark, table, source, ["k"])


@pytest.mark.parametrize("update_cols", [None, ["v"]])
def test_upsert_table_is_idempotent(spark, rows, table, update_cols):
    target, source = frames(spark)
    parquet.upsert_table(spark, table, target, ["k"])
    parquet.upsert_table(spark, table, source, ["k"], update_cols)
    once = rows(spark.read.parquet(table))
    parquet.upsert_table(spark, table, source, ["k"], update_cols)
    assert rows(spark.read.parquet(table)) == once and len(once) == 3


def test_monthly_upsert_touches_only_its_months(spark, rows, table):
    kind = "k string, dt_comptc date, v int"
    january, february = dt.date(2024, 1, 5), dt.date(2024, 2, 5)
    first = spark.createDataFrame([("a", january, 1), ("a", february, 2)], kind)
    parquet.upsert_table(spark, table, first, ["k", "dt_comptc"], month_of="dt_comptc")
    untouched = {f for f in spark.read.parquet(table).inputFiles() if "ym=202401" in f}
    change = spark.createDataFrame([("a", february, 9), ("b", february, 3)], kind)
    parquet.upsert_table(spark, table, change, ["k", "dt_comptc"], month_of="dt_comptc")
    stored = spark.read.parquet(table)
    assert rows(stored, "k", "dt_comptc", "v") == [("a", january, 1), ("a", february, 9), ("b", february, 3)]
    assert untouched <= set(stored.inputFiles())


def test_parent_filters(spark, rows):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, p string")
    parent = spark.createDataFrame([("a",)], "p string")
    assert rows(keys.with_parent(child, parent, ["p"]), "id") == [(1,)]
    assert rows(keys.without(child, parent, ["p"]), "id") == [(2,), (3,)]


# Ranks and lags: the stitched plans equal Spark's windows ----------------------------------


@pytest.fixture
def many_pieces(spark):
    """Keep small shuffle partitions apart, so that small inputs are cut into pieces."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def values(spark, n=3000):
    """Three groups, one of them NULL, with ties, NULL values and one dominant group."""
    group = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold")
    return spark.range(n).select(
        "id", group.alias("g"), F.when(F.col("id") % 13 != 0, F.col("id") * 7919 % 50).alias("v")
    )


def order():
    return [F.col("v").desc_nulls_first(), F.col("id")]


def windowed(df, **columns):
    """What one window over the whole group gives."""
    return df.withColumns({n: c.over(W.partitionBy("g").orderBy(*order())) for n, c in columns.items()})


def test_global_rank_equals_a_window(spark, rows, many_pieces):
    df = values(spark)
    placed = ranking.global_rank(df, order())
    assert rows(placed) == rows(df.withColumn("ranking", F.row_number().over(W.orderBy(*order()))))
    assert sorted(r.ranking for r in placed.collect()) == list(range(1, 3001))


def test_global_rank_of_nothing(spark):
    assert ranking.global_rank(values(spark, 0), order()).count() == 0


def test_group_rank_equals_a_window(spark, rows, many_pieces):
    df = values(spark)
    assert rows(ranking.rank_in_group(df, ["g"], order(), "r")) == rows(windowed(df, r=F.row_number()))


def test_group_lag_equals_a_window(spark, rows, many_pieces):
    df, lags = values(spark), {"before": "v", "before_id": "id"}
    stitched = ranking.lag_in_group(df, ["g"], order(), lags)
    assert rows(stitched) == rows(windowed(df, before=F.lag("v"), before_id=F.lag("id")))


def test_copies_of_one_row_spread_over_pieces(spark, many_pieces):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.lit(1).alias("v"))
    ranked = ranking.rank_in_group(df, ["g"], [F.col("v")], "r")
    assert [r.r for r in ranked.orderBy("r").collect()] == list(range(1, 4001))
    placed = ranking._placed_groups(df, ["g"], [F.col("v")])
    assert placed.select("_piece").distinct().count() > 1


def test_plan_and_jobs_do_not_depend_on_the_size(spark):
    """The same operators, and the same number of jobs while building, for few rows and many."""
    tracker, seen = spark.sparkContext.statusTracker(), []
    for n in (10, 100_000):
        spark.sparkContext.setJobGroup(f"ranks-{n}", "")
        ranked = ranking.rank_in_group(values(spark, n), ["g"], order(), "r")
        jobs = len(tracker.getJobIdsForGroup(f"ranks-{n}"))
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        seen.append((jobs, re.findall(r"(\w+) ", re.sub(r"#\d+L?|\d+", "", plan))))
    spark.sparkContext._jsc.clearJobGroup()
    assert seen[0] == seen[1]


# Filters and paging ---------------------------------------------------------------------------


def dated(spark):
    latest = dt.date(2024, 3, 31)
    return spark.createDataFrame(
        [(n, latest - dt.timedelta(n)) for n in (0, 7, 8, 31, 32)], "n int, dt_comptc date"
    )


@pytest.mark.parametrize(
    "period, kept", [("dia", [0]), ("7_dias", [0, 7]), ("31_dias", [0, 7, 8, 31]), ("outro", [0])]
)
def test_trailing_periods(spark, rows, period, kept):
    assert rows(filters.trailing_period(dated(spark), period), "n") == sorted([(n,) for n in kept], key=str)


def test_grid_filters_are_whitelisted(spark):
    df = dated(spark)
    with pytest.raises(ValueError):
        filters.grid_filter(df, ["n"], {"dt_comptc": "1"})
    with pytest.raises(ValueError):
        filters.grid_sort(["n"], [("dt_comptc", True)])


def test_short_terms_filter_nothing(spark):
    df = spark.createDataFrame([("Fundo",)], "name string")
    assert filters.name_contains(df, "name", "xy", filters.MIN_TERM).count() == 1
    assert filters.name_contains(df, "name", "xyz", filters.MIN_TERM).count() == 0


def test_pages_add_up_to_the_ranking(spark):
    df = spark.range(53)
    pages = [paging.page(df, ["id"], n, 10).collect() for n in range(7)]
    assert [r.id for p in pages for r in p] == list(range(53))
    assert {(r.total, r.total_pages) for p in pages for r in p} == {(53, 6)}
    assert [r.id for r in paging.page_after(df, "id", 9, 10).collect()] == list(range(10, 20))


@pytest.mark.parametrize("number, size", [(-1, 10), (0, 0), (0, 101)])
def test_page_bounds(spark, number, size):
    with pytest.raises(ValueError):
        paging.page(spark.range(1), ["id"], number, size)


def test_all_hits_come_with_the_flag(spark):
    for n in (10, 11):
        hits = paging.flagged(spark.range(n), ["id"]).collect()
        assert [tuple(r) for r in hits] == [(i, n, n > 10) for i in range(n)]


# Bands ------------------------------------------------------------------------------------------


def test_band_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 9.99, 10.0, 10000.0, 20000.0)], "m double")
    counts = {r.faixa_patrimonio: r.gestores for r in aggregates.band_counts(df, "m").collect()}
    assert counts == {"0-10M": 2, "10-100M": 1, "100-500M": 0, "500M-1B": 0, "1-5B": 0, "5-10B": 0, "10B+": 2}
    closed = aggregates.band_counts(df, "m", drop_maximum=True).collect()
    assert closed[-1].gestores == 1


def test_closed_bands_need_a_value_above_the_last_edge(spark):
    df = spark.createDataFrame([(10000.0,)], "m double")
    with pytest.raises(Exception, match="above the last edge"):
        aggregates.band_counts(df, "m", drop_maximum=True).collect()


# Columns ------------------------------------------------------------------------------------------


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("vl", T.DecimalType(5, 2)), T.StructField("x", T.StringType())]
)


def test_conform(spark, rows):
    df = spark.createDataFrame([("1", "1.005"), ("x", "99999")], "id string, vl string")
    assert rows(columns.conform(df, SCHEMA)) == [(None, None, None), (1, Decimal("1.01"), None)]
    assert rows(columns.cast_losses(df, SCHEMA)) == [(1, 1)]
    with pytest.raises(ValueError, match="extra"):
        columns.conform(df.withColumn("extra", F.lit(1)), SCHEMA)
    assert columns.conform(df.withColumn("extra", F.lit(1)), SCHEMA, extra="drop").columns == ["id", "vl", "x"]


def test_wide_number_becomes_null(spark):
    df = spark.createDataFrame([("9" * 53,), ("9" * 38,)], "vl_ativo_exterior string")
    schema = T.StructType([f for f in schemas.block_schema(7) if f.name == "vl_ativo_exterior"])
    assert [r[0] for r in columns.conform(df, schema).collect()] == [None, Decimal("9" * 38)]


def test_rename_does_not_overwrite(spark):
    df = spark.createDataFrame([("a", "b")], "tp_fundo string, tp_fundo_classe string")
    assert columns.rename_present(df, schemas.LAYOUT_RENAMES).columns == ["tp_fundo", "tp_fundo_classe"]


# Tables, views, counters ----------------------------------------------------------------------------


def test_schemas_cover_all_tables(spark):
    assert len(schemas.TABLES) == 17
    sizes = {name: len(schema) for name, schema in schemas.TABLES.items()}
    assert sizes["informacao_cadastral"] == 41 and sizes["informacao_diaria"] == 10
    assert sizes["registro_fundo"] == 21 and sizes["registro_classe"] == 29 and sizes["registro_subclasse"] == 10
    blocks = [sizes[schemas.block_table(b)] for b in range(1, 9)]
    assert blocks == [22, 20, 18, 21, 29, 29, 32, 20]
    assert schemas.TABLES["composicao_carteira_titulo_privado"]["pr_taxa_prefx"].dataType == T.DecimalType(9, 6)


def test_bootstrap_and_lookup(spark):
    from fundspark.sources.tables import table_exists, tables_like

    schemas.bootstrap_views(spark)
    assert table_exists(spark, "registro_fundo") and spark.table("registro_fundo").count() == 0
    assert len(tables_like(spark, "composicao_carteira_")) == 8
    assert schemas.bootstrap_views(spark) == []


def test_example_model(spark, rows):
    views.example_model(spark)
    assert rows(spark.table("example_model")) == [(1, "teste")]


def test_counted(spark):
    df, observation = counters.counted(spark.range(7), "seven")
    df.write.format("noop").mode("overwrite").save()
    assert observation.get["rows"] == 7


# Dates and links in other forms -------------------------------------------------------------------


def test_dates_of_other_forms_are_read(spark):
    from fundspark.functions.dates import fix_invalid_date

    texts = ["2024-12-31", "31/12/2024", "20241231", "31-12-2024", "32/12/2024", "99999999", "x", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [str(r.d) for r in df.select("i", fix_invalid_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert found == ["2024-12-31"] * 4 + ["1900-01-01"] * 3 + ["None"] * 2


def test_links_of_any_quoting_are_found(spark):
    from fundspark.sources.links import extract_links

    html = """<A class=x HREF='one.zip'>1</A> <a href="two.zip?a=1&amp;b=.zip">2</a><a
      href = three.zip>3</a> <a data-href="no.zip">no</a> <area href="no.zip">"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.url for r in extract_links(df).orderBy("ordem").collect()] == ["three.zip", "two.zip?a=1&b=.zip", "one.zip"]


def test_no_holders_is_a_criterion(spark):
    from fundspark.plans.screening import screen_funds

    facts = spark.createDataFrame([("A", 5), ("B", 0)], "denominacao_social string, nr_cotistas int")
    assert [r.denominacao_social for r in screen_funds(facts, holders=0).collect()] == ["B"]


# Text index -------------------------------------------------------------------------------------


@pytest.mark.parametrize("term", ["abc", "ABCA", "aaaa", "b a", "çã", "ÇÃO", "xyz", "abcabcabc", "ab"])
def test_text_index_equals_a_scan(spark, tmp_path, term):
    import random

    from fundspark.operators import text_index

    draw = random.Random(5)
    names = ["".join(draw.choice("abcABC ã") for _ in range(draw.randrange(12))) for _ in range(300)]
    names += ["Ação", "AÇÃO geral", None, "", "aa", "aaaaaaa", "abcabcabcabc"]
    rows = [(f"{i % 200:014d}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame([*rows, rows[0]], "id string, nome string")
    path = text_index.build_text_index(df, "id", "nome", str(tmp_path / "index"))
    if len(term) < 3:
        with pytest.raises(ValueError):
            text_index.search_text_index(spark, path, term)
        return
    found = [tuple(r) for r in text_index.search_text_index(spark, path, term).collect()]
    assert sorted(found) == sorted({(i, n) for i, n in rows if n and term.lower() in n.lower()})


def test_covers_leave_nothing_out():
    import itertools

    from fundspark.operators.text_index import cover

    for size in range(1, 9):
        for counts in itertools.islice(itertools.product([1, 5, 9], repeat=size), 300):
            places = cover(list(counts))
            assert places[0] == 0 and places[-1] == size - 1 and all(b - a <= 3 for a, b in itertools.pairwise(places))
            every = (c for n in range(size + 1) for c in itertools.combinations(range(size), n))
            good = [c for c in every if c and c[0] == 0 and c[-1] == size - 1 and all(b - a <= 3 for a, b in itertools.pairwise(c))]
            assert sum(counts[p] for p in places) == min(sum(counts[p] for p in c) for c in good)


def test_index_plans_read_no_registry_and_few_buckets(spark, capsys, tmp_path):
    from fundspark.operators import text_index

    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("fundo "), F.col("id").cast("string")).alias("nome"))
    df.write.parquet(str(tmp_path / "registry"))
    path = text_index.build_text_index(spark.read.parquet(str(tmp_path / "registry")), "id", "nome", str(tmp_path / "index"))
    hits = text_index.search_text_index(spark, path, "o 1234")
    hits.explain()
    plan = capsys.readouterr().out
    assert "registry" not in plan and "EqualTo(gram," in plan and "dynamicpruning" in plan
    assert [r.key for r in hits.collect()] == ["1234"]


# Deep pages and places ------------------------------------------------------------------------------


def test_far_pages_read_their_places_only(spark, capsys, many_pieces):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("id"))
    for number in (0, 37, 99, 100):
        page = paging.page(df, ["id"], number, 100)
        assert [r.id for r in page.collect()] == list(range(number * 100, min(10_000, number * 100 + 100)))
    paging.page(df, ["id"], 50, 10).explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(_pos," in plan and "Window" not in plan


def test_ranks_follow_lags_without_a_copy(spark, rows, many_pieces, monkeypatch):
    """The row numbers that a lag leaves tell copies apart for a rank, and the result comes sorted."""
    written = []
    monkeypatch.setattr(ranking, "staged", lambda df, name, real=ranking.staged: written.append(name) or real(df, name))
    df = values(spark).unionByName(values(spark)).drop("id")
    by = [F.col("v").desc_nulls_first()]
    lagged = ranking.lag_in_group(df, ["g"], by, {"before": "v"}, number="place")
    ranked = ranking.rank_in_group(lagged, ["g"], by, "r", number="place", groups=[F.col("g").desc_nulls_last()]).drop("place")
    assert written == ["placed", "placed"]
    found = [(r.g, r.v, r.before, r.r) for r in ranked.collect()]
    assert [x[3] for x in found if x[0] == "hot"] == list(range(1, 4201))
    assert [x[0] for x in found] == ["hot"] * 4200 + ["cold"] * 1200 + [None] * 600
    window = W.partitionBy("g").orderBy(*by)
    expected = df.withColumns({"before": F.lag("v").over(window), "r": F.row_number().over(window)})
    assert sorted(map(str, found)) == sorted(str((r.g, r.v, r.before, r.r)) for r in expected.collect())
