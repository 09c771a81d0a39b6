"""Sources that go by byte position: the log tail and archives by their members."""

import io
import random
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from fundspark.sources import archives
from fundspark.streaming import logs, tail


@pytest.fixture
def tailed(spark, tmp_path):
    """Runs the stream until it has all that is there; returns the (line, file) pairs so far."""

    def run(range_bytes=7):
        stream = tail.log_tail(spark, str(tmp_path / "logs"), range_bytes=range_bytes)
        logs.write_logs(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        if not list((tmp_path / "out").rglob("*.parquet")):
            return []
        return sorted((r.mensagem, r.arquivo) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "logs" / "a").mkdir(parents=True)
    return run


def add(path, text):
    with open(path, "ab") as file:
        file.write(text.encode())


def test_appended_lines_arrive_once(tailed, tmp_path):
    one, two = tmp_path / "logs" / "a" / "um.log", tmp_path / "logs" / "dois.log"
    add(one, "alpha\nbeta\r\n\nsem fim")
    add(tmp_path / "logs" / "outro.txt", "não\n")
    first = [("", "um.log"), ("alpha", "um.log"), ("beta", "um.log")]
    assert tailed() == first
    assert tailed() == first
    add(one, " agora\n" + "x" * 50 + "\n")
    add(two, "é\n")
    second = sorted([*first, ("sem fim agora", "um.log"), ("x" * 50, "um.log"), ("é", "dois.log")])
    assert tailed() == second
    two.write_bytes(b"\n")
    assert tailed() == sorted([*second, ("", "dois.log")])
    two.unlink()
    add(one, "fim\n")
    assert tailed(1 << 20) == sorted([*second, ("", "dois.log"), ("fim", "um.log")])


def test_nothing_there(spark, tmp_path, tailed):
    assert tailed() == []
    stream = tail.log_tail(spark, str(tmp_path / "missing"))
    logs.write_logs(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()


@pytest.mark.parametrize("seed", range(20))
def test_ranges_hold_every_line_once(seed):
    draw = random.Random(seed)
    data = b"".join(draw.choice([b"", b"a", b"bc\r", b"d" * draw.randrange(40)]) + b"\n" for _ in range(draw.randrange(60)))
    rest = draw.choice([b"", b"unfinished"])
    file, block = io.BytesIO(data + rest), draw.randrange(1, 50)
    end = tail.lines_end(file, len(data + rest), block)
    assert end == len(data)
    reader = tail.TailReader({"path": "x", "rangebytes": str(draw.randrange(1, 30))})
    found = [row for part in reader.partitions({}, {"x": end} if end else {}) for row in tail.lines_of(file, part, block)]
    at, wanted = 0, []
    for line in data.split(b"\n")[:-1]:
        wanted.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert found == wanted


def test_offsets_of_changed_files():
    reader = tail.TailReader({"path": "x", "rangebytes": "10"})
    places = lambda start, end: [(p.path, p.begin, p.end, p.whole) for p in reader.partitions(start, end)]
    assert places({"a": 5}, {"a": 25}) == [("a", 5, 15, True), ("a", 15, 25, False)]
    assert places({"a": 5, "b": 3}, {"a": 5}) == [] and places({"a": 50}, {"a": 6}) == [("a", 0, 6, True)]


@pytest.fixture
def zips(tmp_path):
    (tmp_path / "zips" / "deep").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "zips" / "a.zip", "w") as bundle:
        for i, method in enumerate((zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_BZIP2)):
            lines = "".join(f"{n};é\r\n" for n in range(i * 9000))
            bundle.writestr(f"x/m{i}.csv", lines.encode("latin-1"), method)
        bundle.writestr("skip.txt", "no")
        bundle.mkdir("x/folder.csv")
    with zipfile.ZipFile(tmp_path / "zips" / "deep" / "b.zip", "w", zipfile.ZIP_DEFLATED) as bundle, pytest.warns(UserWarning):
        bundle.writestr("../up.csv", "one")
        bundle.writestr("twice.csv", "first")
        bundle.writestr("twice.csv", "second")
    return str(tmp_path / "zips")


def test_members_are_partitions_and_their_lines_whole(spark, zips):
    members = archives.archive_members(spark, zips)
    assert members.rdd.getNumPartitions() == members.count() == 5
    lines = archives.read_archives(spark, zips, full_path=True)
    found = {(r.archive, r.member): (r.n, r.least, r.most) for r in lines.groupBy("archive", "member").agg(
        F.count("*").alias("n"), F.min("line_no").alias("least"), F.max("line_no").alias("most")).collect()}
    assert found == {
        ("a.zip", "x/m1.csv"): (9000, 0, 8999), ("a.zip", "x/m2.csv"): (18000, 0, 17999),
        ("b.zip", "../up.csv"): (1, 0, 0), ("b.zip", "twice.csv"): (1, 0, 0),
    }
    assert lines.filter("line = concat(line_no, ';é')").count() == 27000
    assert lines.filter("member = 'twice.csv'").first().line == "second"


def test_landed_bytes(spark, zips, tmp_path):
    out = tmp_path / "out"
    for _again in range(2):
        landed = {r.member: (r.path, r.bytes) for r in archives.land_members(spark, zips, str(out)).collect()}
    assert landed["../up.csv"] == (f"{out}/b.zip/up.csv/part-0.csv", 3)
    assert (out / "a.zip" / "x" / "m0.csv" / "part-0.csv").read_bytes() == b""
    with zipfile.ZipFile(f"{zips}/a.zip") as bundle:
        assert (out / "a.zip" / "x" / "m2.csv" / "part-0.csv").read_bytes() == bundle.read("x/m2.csv")
    assert not list(out.rglob("_*")) and len(list(out.rglob("part-0.csv"))) == 5


def test_damaged_members_fail(spark, zips, tmp_path):
    data = bytearray((tmp_path / "zips" / "a.zip").read_bytes())
    data[data.index(b"1234;")] += 1
    (tmp_path / "zips" / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum|invalid|Error"):
        archives.read_archives(spark, zips).count()


def test_no_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_a_member_is_unpacked_in_bounded_memory(tmp_path):
    """A gigabyte of zeros in a megabyte of archive is never held as a whole."""
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle, bundle.open("big.csv", "w", force_zip64=True) as member:
        for _ in range(1024):
            member.write(b"0" * (1 << 20))
    info = zipfile.ZipFile(path).infolist()[0]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with open(path, "rb") as file:
        read = io.BufferedReader(archives.Member(
            file, info.header_offset, info.compress_size, info.file_size, info.compress_type, info.CRC), 1 << 20)
        total = sum(len(block) for block in iter(lambda: read.read(1 << 20), b""))
    assert total == 1 << 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
