"""Fixed-width text: a field list turned into native substring and cast expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.dates import compact_date
from fundspark.functions.numbers import parse_or


class Field(NamedTuple):
    name: str
    start: int  # zero-based
    end: int
    kind: str  # date | price | count | factor | text


# The daily quote record.
QUOTE_FIELDS = [
    Field("data_pregao", 2, 10, "date"),
    Field("codigo_bdi", 10, 12, "text"),
    Field("codigo_negociacao", 12, 24, "text"),
    Field("tipo_mercado", 24, 27, "text"),
    Field("nome_empresa", 27, 39, "text"),
    Field("especificacao_papel", 39, 49, "text"),
    Field("prazo_dias_mercado", 49, 52, "count"),
    Field("moeda_referencia", 52, 56, "text"),
    Field("preco_abertura", 56, 69, "price"),
    Field("preco_maximo", 69, 82, "price"),
    Field("preco_minimo", 82, 95, "price"),
    Field("preco_medio", 95, 108, "price"),
    Field("preco_ultimo", 108, 121, "price"),
    Field("preco_melhor_oferta_compra", 121, 134, "price"),
    Field("preco_melhor_oferta_venda", 134, 147, "price"),
    Field("numero_negocios", 147, 152, "count"),
    Field("quantidade_titulos", 152, 170, "count"),
    Field("volume_total", 170, 188, "count"),
    Field("preco_exercicio", 188, 201, "price"),
    Field("indicador_correcao", 201, 202, "text"),
    Field("data_vencimento", 202, 210, "date"),
    Field("fator_cotacao", 210, 217, "factor"),
    Field("preco_exercicio_pontos", 217, 230, "price"),
    Field("codigo_isin", 230, 242, "text"),
    Field("distribuicao", 242, 245, "text"),
]
QUOTE_HEADER = "00COTAHIST"
# 245 characters with the line break, which the text source strips.
QUOTE_LENGTH = 244
NO_DATE = ("", "00000000")
NO_FACTOR = "0000000"


def _text(field: Field) -> Column:
    return F.trim(F.substring("line", field.start + 1, field.end - field.start))


def _value(field: Field, zero_as_null: bool) -> Column:
    """The typed value of a field's trimmed text; NULL when absent or unreadable."""
    text = F.col(f"_{field.name}")
    if field.kind == "text":
        return F.nullif(text, F.lit(""))
    if field.kind == "date":
        return F.when(~text.isin(*NO_DATE), compact_date(text))
    if field.kind == "price":
        price = F.when(text != "", text.try_cast("double")) / 100
        return F.nullif(price, F.lit(0.0)) if zero_as_null else price
    if field.kind == "factor":
        return F.when(text == NO_FACTOR, F.lit(1).cast("long")).otherwise(parse_or(text, "long", 1))
    return parse_or(text, "long", 0)


def _unreadable(field: Field) -> Column | None:
    """Whether a field's text stands for no value of its kind; None for text fields."""
    missing, text = F.col(field.name).isNull(), F.col(f"_{field.name}")
    if field.kind == "text":
        return None
    if field.kind == "date":
        return missing & ~text.isin(*NO_DATE)
    if field.kind == "price":
        return missing & (text != "") & text.try_cast("double").isNull()
    return missing


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Text lines as column ``line``. Bytes that are not valid UTF-8 fail the job."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        lines = spark.read.text(path)
        return lines.select(F.validate_utf8("value").alias("line"), F.col("_metadata.file_name").alias("arquivo_origem"))
    # The CSV reader decodes; no separator or quote can occur in a text line.
    lines = (
        spark.read.schema("line string")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("encoding", encoding)
        .csv(path)
    )
    return lines.select("line", F.col("_metadata.file_name").alias("arquivo_origem"))


def classify_lines(
    lines: DataFrame, fields: Sequence[Field] = QUOTE_FIELDS, zero_as_null: bool = False
) -> DataFrame:
    """Every line with its parsed fields and a ``situacao_linha``: ``valida``,
    ``cabecalho``, ``vazia``, ``curta`` or ``ilegivel``.

    Cutting, typing and judging are separate projections, so that each field is cut
    and cast once.
    """
    cut = lines.select("*", *[_text(f).alias(f"_{f.name}") for f in fields])
    typed = cut.select("*", *[_value(f, zero_as_null).alias(f.name) for f in fields])
    unreadable = reduce(or_, [u for u in map(_unreadable, fields) if u is not None])
    line = F.col("line")
    state = (
        F.when(F.trim(line) == "", "vazia")
        .when(F.startswith(line, F.lit(QUOTE_HEADER)), "cabecalho")
        .when(F.length(line) < QUOTE_LENGTH, "curta")
        .when(unreadable, "ilegivel")
        .otherwise("valida")
    )
    return typed.select(*lines.columns, *[f.name for f in fields], state.alias("situacao_linha"))


def parse_lines(
    lines: DataFrame, fields: Sequence[Field] = QUOTE_FIELDS, zero_as_null: bool = False
) -> DataFrame:
    """The valid lines, parsed.

    The rows are chosen by a generator instead of a filter, which Spark would push
    below the casts and evaluate them twice.
    """
    parsed = classify_lines(lines, fields, zero_as_null)
    kept = [c for c in parsed.columns if c not in ("line", "situacao_linha")]
    valid = F.when(F.col("situacao_linha") == "valida", F.array(F.struct(*kept)))
    return parsed.select(F.inline(valid))


def rejected_lines(lines: DataFrame, fields: Sequence[Field] = QUOTE_FIELDS) -> DataFrame:
    """Lines that are neither valid, blank nor a header, with the reason."""
    bad = classify_lines(lines, fields).filter("situacao_linha IN ('curta', 'ilegivel')")
    return bad.select("line", "situacao_linha")
