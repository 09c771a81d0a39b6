"""ZIP archives: their text members as lines or as landed files."""

from __future__ import annotations

import bz2
import io
import itertools
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fundspark.session import staged
from fundspark.sources.stores import files_below, located

LINES = "archive string, member string, line_no long, line string"
BATCH = 10_000


def unpack_archives(
    archives: DataFrame, suffix: str = ".csv", encoding: str = "latin-1", full_path: bool = False
) -> DataFrame:
    """``(archive, member, line_no, line)`` from ``(archive, content)`` rows, for every
    member ending in ``suffix``. Members are decompressed as a stream of batches; they go by
    their file names, or by their whole paths in the archive."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Everything that runs on executors is in here: they need not have this package.
        def lines_of(bundle: zipfile.ZipFile, archive: str, member: str) -> Iterator[pd.DataFrame]:
            with io.TextIOWrapper(bundle.open(member), encoding=encoding) as text:
                first = 0
                while rows := [line.rstrip("\r\n") for line in itertools.islice(text, size)]:
                    yield pd.DataFrame(
                        {
                            "archive": archive,
                            "member": member if full_path else member.rsplit("/", 1)[-1],
                            "line_no": range(first, first + len(rows)),
                            "line": rows,
                        }
                    )
                    first += len(rows)

        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    for member in bundle.namelist():
                        if member.endswith(suffix):
                            yield from lines_of(bundle, archive, member)

    size = BATCH
    return archives.select("archive", "content").mapInPandas(unpack, LINES)


# Archives by their members ----------------------------------------------------------

MEMBERS = (
    "archive string, path string, member string, offset bigint, compressed bigint, size bigint, "
    "method int, crc bigint"
)
LISTED_AT_ONCE = 16
BLOCK_BYTES = 1 << 20
STORED, DEFLATED, BZIP2 = 0, 8, 12


@dataclass
class MemberPart(InputPartition):
    """Where a member lies in its archive, as the archive's directory has it."""

    row: tuple


class MemberReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder = options["path"]
        self.suffix, self.kind = options.get("suffix", ".csv"), options.get("archives", ".zip")

    def partitions(self) -> list[MemberPart]:
        """One per member. Of an archive only its directory is read, several at a time."""
        with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
            listed = pool.map(self.members, [i.path for i in files_below(self.folder, self.kind)])
            return [MemberPart(row) for rows in listed for row in rows]

    def members(self, path: str) -> list[tuple]:
        store, _ = located(self.folder)
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as bundle:
            # Of several members of one name the last counts, as for the usual tools.
            last = {m.filename: m for m in bundle.infolist() if not m.is_dir() and m.filename.endswith(self.suffix)}
        for m in last.values():
            if m.flag_bits & 1 or m.compress_type not in (STORED, DEFLATED, BZIP2):
                raise ValueError(f"{path}: {m.filename} is encrypted or packed by an unknown method")
        name = path.rsplit("/", 1)[-1]
        return [
            (name, path, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC)
            for m in last.values()
        ]

    def read(self, partition: MemberPart | None) -> Iterator[tuple]:
        # Without any member Spark asks for one partition that is None.
        if partition is not None:
            yield partition.row


class ZipMembers(DataSource):
    """``spark.read.format("zip_members")``, with ``path``, ``suffix`` and ``archives``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


class Member(io.RawIOBase):
    """A member's bytes, read from its place in the archive, unpacked piece by piece and checked at the end."""

    def __init__(self, file, offset: int, compressed: int, size: int, method: int, crc: int):
        file.seek(offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no member where the directory says")
        file.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        self.file, self.left, self.size, self.crc = file, compressed, size, crc
        self.unpacker = {DEFLATED: lambda: zlib.decompressobj(-15), BZIP2: bz2.BZ2Decompressor}.get(method, lambda: None)()
        self.packed, self.read_bytes, self.read_crc = b"", 0, 0

    def readable(self) -> bool:
        return True

    def _unpacked(self, most: int) -> bytes:
        while True:
            if not self.packed and self.left:
                self.packed = self.file.read(min(self.left, BLOCK_BYTES))
                if not self.packed:
                    raise zipfile.BadZipFile("the archive ends within a member")
                self.left -= len(self.packed)
            if self.unpacker is None:
                out, self.packed = self.packed[:most], self.packed[most:]
            elif isinstance(self.unpacker, bz2.BZ2Decompressor):
                out = b"" if self.unpacker.eof else self.unpacker.decompress(self.packed, most)
                self.packed = b""
                if not out and not self.left and not self.unpacker.eof and self.unpacker.needs_input:
                    return out
            else:
                out = self.unpacker.decompress(self.packed, most)
                self.packed = self.unpacker.unconsumed_tail
            if out or not (self.packed or self.left):
                return out

    def readinto(self, buffer) -> int:
        data = self._unpacked(len(buffer))
        if not data and (self.read_bytes, self.read_crc) != (self.size, self.crc):
            raise zipfile.BadZipFile("a member's bytes do not fit its checksum")
        self.read_bytes, self.read_crc = self.read_bytes + len(data), zlib.crc32(data, self.read_crc)
        buffer[: len(data)] = data
        return len(data)


def archive_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """The members of all ``*.zip`` files below a folder, each a partition of its own."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("suffix", suffix).load(path)


def _members(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[dict, io.BufferedReader]]:
    """The members that a task has, opened one after the other."""
    store, _ = located(path)
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(row["path"]) as file:
                place = {k: row[k] for k in ("offset", "compressed", "size", "method", "crc")}
                yield row, io.BufferedReader(Member(file, **place), BLOCK_BYTES)


def read_archives(
    spark: SparkSession,
    path: str,
    suffix: str = ".csv",
    encoding: str = "latin-1",
    full_path: bool = False,
) -> DataFrame:
    """The lines of all ``*.zip`` files below a folder.

    Every member is a task, which goes to the member's place in the archive and unpacks it
    piece by piece: neither an archive nor a member is held as a whole, and archives may
    have any size. Members with a damaged checksum fail.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, member in _members(batches, path):
            text, first = io.TextIOWrapper(member, encoding=encoding), 0
            name = row["member"] if full_path else row["member"].rsplit("/", 1)[-1]
            while rows := [line.rstrip("\r\n") for line in itertools.islice(text, BATCH)]:
                n = len(rows)
                columns = [[row["archive"]] * n, [name] * n, pa.array(range(first, first + n), pa.int64()), rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["archive", "member", "line_no", "line"]
                )
                first += n

    return archive_members(spark, path, suffix).mapInArrow(lines, LINES)


def land_members(spark: SparkSession, path: str, out: str, suffix: str = ".csv") -> DataFrame:
    """Write every member below ``out`` and return ``archive, member, path, bytes`` of each.

    A member becomes ``out/archive/path/name.csv``, a folder with one file that has its bytes. The
    task that unpacks it writes it under a name of its own and renames it when it is whole, so
    that a repeated task does no harm. Parts of a member's name that lead upwards are left out.
    """

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = located(out)
        for row, member in _members(batches, path):
            inside = [p for p in row["member"].split("/") if p not in ("", ".", "..")]
            folder = "/".join([root.rstrip("/"), row["archive"], *inside])
            target.create_dir(folder, recursive=True)
            unfinished, written = f"{folder}/_{uuid.uuid4().hex}", 0
            with target.open_output_stream(unfinished) as file:
                while block := member.read(BLOCK_BYTES):
                    file.write(block)
                    written += len(block)
            target.move(unfinished, f"{folder}/part-0{suffix}")
            columns = [[row["archive"]], [row["member"]], [f"{folder}/part-0{suffix}"], pa.array([written], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["archive", "member", "path", "bytes"])

    landed = archive_members(spark, path, suffix).mapInArrow(land, "archive string, member string, path string, bytes bigint")
    return staged(landed, "landed")
