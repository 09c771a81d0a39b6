"""Delimited text: every column as string, layouts by header, published bad-line rule."""

from __future__ import annotations

import csv
from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundspark.operators.columns import lower_columns, rename_present
from fundspark.sources.tables import file_system

SEPARATOR = ";"
ENCODING = "ISO-8859-1"
BAD = "_bad_line"
# File order of a row; a row id alone does not order rows across files.
LINE_ORDER = ["_file", "_block", "_line"]


def _options(reader, separator: str, encoding: str):
    return (
        reader.option("sep", separator)
        .option("encoding", encoding)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
    )


def layout_reader(reader, header: Sequence[str], separator: str = SEPARATOR, encoding: str = ENCODING):
    """A reader for files with this header, all columns as strings.

    Malformed lines keep their fields and their text; a file with another header fails.
    """
    fields = [T.StructField(name, T.StringType()) for name in [*header, BAD]]
    return (
        _options(reader, separator, encoding)
        .schema(T.StructType(fields))
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("columnPruning", False)
    )


def header_of(
    spark: SparkSession, path: str, separator: str = SEPARATOR, encoding: str = ENCODING
) -> list[str]:
    """Column names from the first line of a file (of a folder: of its first part that is
    not empty), which may be compressed as its name tells, read by the driver: no Spark job."""
    fs, at = file_system(spark, path)
    file = at(path)
    if fs.getFileStatus(file).isDirectory():
        parts = [(p.getPath().toString(), p.getPath()) for p in fs.listStatus(file) if p.isFile() and p.getLen()]
        shown = [p for p in sorted(parts, key=lambda p: p[0]) if p[0].rsplit("/", 1)[-1][0] not in "_."]
        if not shown:
            raise FileNotFoundError(f"no file in {path}")
        file = shown[0][1]
    jvm = spark.sparkContext._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(fs.getConf()).getCodec(file)
    io, opened = jvm.java.io, fs.open(file)
    content = codec.createInputStream(opened) if codec else opened
    lines = io.BufferedReader(io.InputStreamReader(content, encoding))
    try:
        first = lines.readLine()
    finally:
        lines.close()
    if not first:
        raise ValueError(f"{path} has no header")
    return next(csv.reader([first.lstrip("\ufeff")], delimiter=separator))


def _too_long(header: Sequence[str], separator: str) -> Column:
    """Whether the line has more fields than the header; never NULL."""
    line = F.col(BAD)
    unquoted = F.regexp_replace(line, r'"[^"]*"', "")
    separators = F.length(unquoted) - F.length(F.translate(unquoted, separator, ""))
    # Always true; Spark rejects queries that refer to nothing but the bad-line column.
    any_field = F.length(F.coalesce(F.col(header[0]), F.lit(""))) >= 0
    return line.isNotNull() & (separators >= len(header)) & any_field


def located_lines(
    raw: DataFrame, header: Sequence[str], bad_lines: str = "skip", separator: str = SEPARATOR
) -> DataFrame:
    """The layout's columns with each line's file and block.

    Short lines are padded with NULL. Lines with too many fields are skipped, or
    fail the job (``bad_lines="fail"``).
    """
    too_long = _too_long(header, separator)
    if bad_lines == "fail":
        message = F.concat(F.lit("line has too many fields: "), F.col(BAD))
        keep = F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    else:
        keep = ~too_long
    return raw.filter(keep).select(
        *header,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def read_layout(
    spark: SparkSession,
    paths: Sequence[str],
    header: Sequence[str],
    bad_lines: str = "skip",
    separator: str = SEPARATOR,
    encoding: str = ENCODING,
) -> DataFrame:
    """Files of one layout as strings plus ``LINE_ORDER`` columns."""
    raw = layout_reader(spark.read, header, separator, encoding).csv(list(paths))
    lines = located_lines(raw, header, bad_lines, separator)
    return lines.withColumn("_line", F.monotonically_increasing_id())


def read_delimited(
    spark: SparkSession,
    paths: Iterable[str],
    bad_lines: str = "skip",
    separator: str = SEPARATOR,
    encoding: str = ENCODING,
    alike: Callable[[str], Hashable] = lambda path: path,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Files of possibly different layouts as one frame with lower-case columns,
    ``renames`` applied to the layouts that have the old names.

    The driver reads the first line of one file per ``alike`` group to learn its header, and
    one scan per distinct header follows. A file that breaks its group's layout
    fails the job.
    """
    groups: dict[Hashable, list[str]] = {}
    for path in paths:
        groups.setdefault(alike(path), []).append(path)
    if not groups:
        raise FileNotFoundError("no input file")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for group in groups.values():
        header = header_of(spark, group[0], separator, encoding)
        layouts.setdefault(tuple(header), []).extend(group)
    frames = [
        rename_present(
            lower_columns(read_layout(spark, group, header, bad_lines, separator, encoding)),
            renames or {},
        )
        for header, group in layouts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reject_report(
    spark: SparkSession, paths: Sequence[str], separator: str = SEPARATOR, encoding: str = ENCODING
) -> DataFrame:
    """The lines ``read_layout`` skips, with their file."""
    header = header_of(spark, paths[0], separator, encoding)
    raw = layout_reader(spark.read, header, separator, encoding).csv(list(paths))
    file_name = F.col("_metadata.file_name").alias("arquivo_origem")
    return raw.filter(_too_long(header, separator)).select(
        file_name, F.col(BAD).alias("linha"), F.col(header[0]).alias("primeiro_campo")
    )
