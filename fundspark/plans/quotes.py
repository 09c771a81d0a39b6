"""Daily stock quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.numbers import round_half_even
from fundspark.sources.fixed_width import parse_lines, read_lines


def with_day_move(quotes: DataFrame) -> DataFrame:
    """Percent move from opening to last price; NULL when the opening price is zero."""
    opening, last = F.col("preco_abertura"), F.col("preco_ultimo")
    move = F.try_divide(last - opening, opening) * 100
    return quotes.withColumn("variacao_percentual", round_half_even(move, 2))


def load_quotes(
    spark: SparkSession, path: str, encoding: str = "UTF-8", zero_as_null: bool = False
) -> DataFrame:
    """Parsed quote files with processing date, source file and day move."""
    quotes = parse_lines(read_lines(spark, path, encoding), zero_as_null=zero_as_null)
    return with_day_move(quotes.withColumn("data_processamento", F.current_date()))
