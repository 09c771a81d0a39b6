"""Log tail: a streaming source of the lines that are added to files, by byte position.

An offset holds, for every file, the byte behind the last whole line that was seen, so that
lines appended to a file arrive once, also after a restart from a checkpoint. The bytes between
two offsets are read in ranges of bounded size, one task each; a line belongs to the range in
which it starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fundspark.functions.dates import day_bucket
from fundspark.sources.stores import files_below, located

#: Bytes of a range, of what is read at once, and lines of an Arrow batch.
RANGE_BYTES, BLOCK_BYTES, BATCH_LINES = 64 << 20, 1 << 20, 10_000
SCHEMA = "mensagem string, arquivo string, posicao bigint"


@dataclass
class Range(InputPartition):
    """The lines of a file that start in [begin, end); ``end`` is no further than a line's end."""

    path: str
    begin: int
    end: int
    #: Whether a line starts at ``begin``; otherwise it may start in the middle of one.
    whole: bool


def lines_end(file, size: int, block: int = BLOCK_BYTES) -> int:
    """The place behind the last line break in the first ``size`` bytes, 0 without one."""
    at = size
    while at > 0:
        begin = max(0, at - block)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_of(file, part: Range, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that starts in a range; the last may end behind it."""
    at = part.begin if part.whole else part.begin - 1
    file.seek(at)
    rest, skip = b"", not part.whole
    while at < part.end:
        read = file.read(block)
        if not read:
            return
        *lines, rest = (rest + read).split(b"\n")
        for line in lines:
            if not skip:
                yield at, line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
            if at >= part.end:
                return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", ".log")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the whole lines of every file; only files that changed are looked into."""
        store, _ = located(self.folder)
        found = {}
        for info in files_below(self.folder, self.suffix):
            size, end = self.seen.get(info.path, (-1, 0))
            if size != info.size:
                with store.open_input_file(info.path) as file:
                    end = lines_end(file, info.size)
            found[info.path] = (info.size, end)
        self.seen = found
        return {path: end for path, (_, end) in found.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            # A file that became shorter was begun anew.
            begin = 0 if begin > stop else begin
            for at in range(begin, stop, self.range_bytes):
                out.append(Range(path, at, min(at + self.range_bytes, stop), at == begin))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.folder)
        name = partition.path.rsplit("/", 1)[-1]

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            lines = [line.decode("utf-8", "replace") for _, line in rows]
            columns = [pa.array(lines, pa.string()), pa.array([name] * len(rows), pa.string()),
                       pa.array([at for at, _ in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["mensagem", "arquivo", "posicao"])

        rows = []
        with store.open_input_file(partition.path) as file:
            for row in lines_of(file, partition):
                rows.append(row)
                if len(rows) >= BATCH_LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class LogLines(DataSource):
    """``spark.readStream.format("log_lines")``, with ``path``, ``suffix`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def log_tail(spark: SparkSession, folder: str, suffix: str = ".log", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of all log files below ``folder`` as they are added, with file, byte position and arrival day.

    A line arrives when its line break is there. A file that has become shorter than what was read
    of it was begun anew and is read from its start; one that went is forgotten. The offset has
    one entry per file. Bytes that are not UTF-8 are replaced.
    """
    spark.dataSource.register(LogLines)
    lines = spark.readStream.format("log_lines").option("suffix", suffix).option("rangeBytes", range_bytes).load(folder)
    return lines.withColumn("dia", day_bucket(F.current_timestamp()))
