"""File discovery: which landed files to read, from their names alone."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Published file names.
DAILY_NAME = re.compile(r"^inf_diario_fi_(\d{6})\.csv$")
BLOCK_NAME = re.compile(r"^cda_fi_BLC_(\d)_(\d{6})\d*\.csv(?:\.gz)?$")
# The month inside a block file's path, for use in a column expression.
BLOCK_MONTH = r"cda_fi_BLC_\d_(\d{6})"


@dataclass(frozen=True)
class LandedFile:
    path: str
    month: str
    block: int | None = None


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths of the files below ``folder``; listing only, nothing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        listing = reader.option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as error:
        raise FileNotFoundError(folder) from error
    return sorted(unquote(uri) for uri in listing.inputFiles())


def _named(paths: Iterable[str], pattern: re.Pattern) -> list[tuple[str, re.Match]]:
    """Files whose name matches, or that lie in a folder whose name does (a file
    published in parts)."""
    found = []
    for path in paths:
        match = next(filter(None, map(pattern.match, path.split("/")[:-3:-1])), None)
        if match:
            found.append((path, match))
    return found


def daily_files(
    spark: SparkSession, folder: str, since: str = "", latest_only: bool = False
) -> list[LandedFile]:
    """All daily files, oldest first; from month ``since`` on or only the newest month if asked for."""
    found = [LandedFile(p, m[1]) for p, m in _named(list_files(spark, folder, "*.csv"), DAILY_NAME)]
    wanted = sorted((f for f in found if f.month >= since), key=lambda f: f.month)
    if not wanted:
        raise FileNotFoundError(f"no daily file {f'since {since} ' if since else ''}in {folder}")
    return [f for f in wanted if f.month == wanted[-1].month] if latest_only else wanted


def portfolio_files(spark: SparkSession, folder: str) -> list[LandedFile]:
    """Portfolio block files, gzipped or not, newest month first, then by block."""
    paths = list_files(spark, folder, "*.{csv,csv.gz}")
    found = [LandedFile(p, m[2], int(m[1])) for p, m in _named(paths, BLOCK_NAME)]
    if not found:
        raise FileNotFoundError(f"no portfolio file in {folder}")
    return sorted(found, key=lambda f: (-int(f.month), f.block))


def month_start(token: str) -> dt.date:
    return dt.datetime.strptime(token, "%Y%m").date()
