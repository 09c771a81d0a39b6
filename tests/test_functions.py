"""Column functions on hand-made values."""

import datetime as dt

from pyspark.sql import functions as F

from fundspark.functions import dates, numbers, text


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_tax_ids_keep_null_and_restore_zeros(spark):
    ids = ["12.345.678/0001-99", "12345678000199", "2345678000199", None, " ", "123456789012345"]
    assert one(spark, text.pad_tax_id, ids) == [
        "12345678000199", "12345678000199", "02345678000199", None, None, "123456789012345",
    ]


def test_personal_ids_are_only_stripped(spark):
    assert one(spark, text.strip_tax_id, ["123.456.789-01", None]) == ["12345678901", None]


def test_format_round_trip(spark):
    assert one(spark, text.format_tax_id, ["12345678000199"]) == ["12.345.678/0001-99"]


def test_fixed_chars(spark):
    assert one(spark, lambda c: text.fixed_chars(c, 1), ["", " ", " S ", "SIM", None]) == [
        None, None, "S", "S", None,
    ]
    assert one(spark, lambda c: text.fixed_chars(c, 2), ["PJX"]) == ["PJ"]


def test_truncate_only_cuts_long_text(spark):
    assert one(spark, lambda c: text.truncate(c, 3), ["ação", "ab", None]) == ["açã", "ab", None]


def test_contains_ignores_case(spark):
    assert one(spark, lambda c: text.contains_ignoring_case(c, "ÇÕ"), ["Ações", "acoes"]) == [True, False]


def test_join_text_skips_null(spark):
    assert one(spark, lambda c: text.join_text(F.lit("a"), c), ["b", None]) == ["ab", "a"]


def test_invalid_dates(spark):
    values = ["2024-01-31", "2024-99-01", "0202-01-01", "", " ", None, "x"]
    old = dt.date(1900, 1, 1)
    assert one(spark, dates.fix_invalid_date, values) == [
        dt.date(2024, 1, 31), old, dt.date(202, 1, 1), None, None, None, old,
    ]
    bounded = one(spark, lambda c: dates.fix_invalid_date(c, nanosecond_range=True), values)
    assert bounded[2] == old and bounded[0] == dt.date(2024, 1, 31)


def test_a_column_without_any_valid_date(spark):
    assert one(spark, dates.fix_invalid_date, ["x", "y"]) == [dt.date(1900, 1, 1)] * 2


def test_compact_date_and_month_token(spark):
    assert one(spark, dates.compact_date, ["20240131", "20241332", ""]) == [dt.date(2024, 1, 31), None, None]
    names = ["inf_diario_fi_202401.csv", "cda_fi_BLC_1_202402.csv", "registro_fundo.csv"]
    assert one(spark, dates.month_token, names) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), None]


def test_day_bucket(spark):
    assert one(spark, dates.day_bucket, [dt.date(2024, 3, 9)], "date") == ["2024.03.09"]


def test_finite_or_null(spark):
    assert one(spark, numbers.finite_or_null, [1.5, float("nan"), float("inf"), None], "double") == [
        1.5, None, None, None,
    ]


def test_log_ratio_needs_a_positive_ratio(spark):
    previous = [2.0, 0.0, -1.0, None]
    assert one(spark, lambda c: numbers.log_ratio(F.lit(2.0), c), previous, "double") == [0.0, None, None, None]


def test_percent_change_needs_a_positive_base(spark):
    assert one(spark, lambda c: numbers.percent_change(F.lit(3.0), c), [2.0, 0.0, -1.0, None], "double") == [
        50.0, None, None, None,
    ]


def test_percent_of(spark):
    def percent(whole):
        return numbers.percent_of(F.lit("1.00").cast("decimal(27,2)"), whole).cast("string")

    wholes = ["800.00", "0.00", "-5.00", None]
    df = spark.createDataFrame([(w,) for w in wholes], "v string")
    found = [r[0] for r in df.select(percent(F.col("v").cast("decimal(17,2)"))).collect()]
    assert found == ["0.13", "0.00", "0.00", "0.00"]


def test_percent_overflow_is_null(spark):
    df = spark.sql("SELECT CAST(1e9 AS DECIMAL(27,2)) AS n, CAST(0.01 AS DECIMAL(17,2)) AS t")
    assert df.select(numbers.percent_of(F.col("n"), F.col("t"))).first()[0] is None


def test_round_half_even(spark):
    assert one(spark, lambda c: numbers.round_half_even(c, 2), [0.125, 0.375, 2.675], "double") == [0.12, 0.38, 2.68]


def test_parse_or(spark):
    assert one(spark, lambda c: numbers.parse_or(c, "long", 1), ["007", " ", "x", None]) == [7, 1, None, None]


def test_serving_shapes(spark):
    assert one(spark, numbers.zero_if_empty, [None, 0.0, 2.5], "double") == [0.0, 0.0, 2.5]
    assert one(spark, numbers.null_if_zero, [None, 0.0, 2.5], "double") == [None, None, 2.5]
