"""Removal of repeated passages by a distributed sparse suffix array.

A byte is removed when a string of ``WIDTH`` bytes that covers it also starts in a document
with a smaller doc_id. Texts are UTF-8 bytes; strings never cross documents.

Suffixes are taken at anchors only: the positions whose ``SEED`` bytes hash lowest in some
string of ``WIDTH``. Equal strings have their anchors at equal offsets, so every repeated
string shows as two suffixes that agree around an anchor.

1. Documents are grouped into chunks, staged once.
2. Anchor hashes that occur in one document only cannot repeat and are left out.
3. The suffixes at the other anchors (what follows the anchor, then what precedes it, read
   backwards) are range-partitioned by their leading bytes, at splitters from a sample.
4. Each bucket sorts its suffixes by multikey quicksort, eight bytes at a time, and compares
   neighbours. For each offset of the string around the anchor, suffixes with a common
   prefix and common preceding bytes form a class, whose least doc_id decides. Equal leading
   bytes never lie on both sides of a splitter, so a class never crosses a boundary.
5. Chunks learn which strings to remove, and cut them out.

Each chunk sends every distinct suffix once, so that a passage in any number of documents
costs a bucket one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.texts import mixed, pieces

WIDTH, SEED = 50, 20
#: Bytes before an anchor that a string can begin with.
BEFORE = WIDTH - SEED
CHUNK_BYTES = 1 << 20
#: Text bytes for each bucket of suffixes, and for each bucket of anchor hashes (some 11 MB of them).
BUCKET_BYTES = 8 << 20
KEY_BUCKET_BYTES = 32 << 20
#: One of so many suffixes of a chunk goes into the sample for the splitters.
SAMPLED = 64
_RECORD = WIDTH + BEFORE + 2
_NO_ID = np.iinfo(np.int64).max


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# --- one chunk -------------------------------------------------------------------------


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Chunk:
    """The documents of a chunk as one array of bytes, with their anchors."""

    def __init__(self, blob: bytes):
        with pa.ipc.open_stream(_unpacked(blob)) as stream:
            self.rows = next(iter(stream))
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in self.rows.column("text").to_pylist()]
        ids = self.rows.column("doc_id").to_pylist()
        self.ids = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.at, self.hashes = self._anchors()
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        if n < WIDTH:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        a = 0x9E3779B97F4A7C15
        # Hashes of runs of 1, 2, 4, ... bytes by doubling; those that make up SEED are joined.
        run, span, total, at = self.data.astype(np.uint64) + np.uint64(1), 1, None, 0
        while span <= SEED:
            power = np.uint64(pow(a, span, 1 << 64))
            if SEED & span:
                piece = run[at : at + n - SEED + 1]
                total = piece if total is None else total * power + piece
                at += span
            run = run[:-span] * power + run[span:]
            span *= 2
        del run
        seeds = mixed(total)
        lowest = _slide(seeds, BEFORE + 1, np.minimum)
        for end in self.ends[:-1].tolist():  # no string goes over the end of a document
            lowest[max(0, end - WIDTH + 1) : end] = 0
        edge = np.zeros(BEFORE, dtype=np.uint64)
        chosen = _slide(np.concatenate([edge, lowest, edge]), BEFORE + 1, np.maximum) == seeds
        at = np.flatnonzero(chosen)
        return at, seeds[at]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes (48 bits, ascending), each anchor's place among them, and
        which of them occur in two documents of this chunk.

        Anchors have the lowest hash of some string, so that these crowd at the low end; mixed
        once more they spread evenly, and so do their buckets."""
        keys, place = np.unique(mixed(self.hashes) >> np.uint64(16), return_inverse=True)
        low = np.full(len(keys), _NO_ID)
        high = np.full(len(keys), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return keys, place, low < high

    def suffixes(self, chosen: np.ndarray) -> Suffixes:
        return Suffixes(self, np.flatnonzero(chosen))


class Suffixes:
    """The distinct suffixes at some anchors of a chunk, in order."""

    def __init__(self, chunk: Chunk, which: np.ndarray):
        at, doc = chunk.at[which], chunk.doc[which]
        begins = chunk.ends[doc] - chunk.sizes[doc]
        before = np.minimum(at - begins, BEFORE)
        behind = np.minimum(chunk.ends[doc] - at, WIDTH)
        records = np.zeros((len(at), _RECORD), dtype=np.uint8)
        for i in range(WIDTH):
            fits = behind > i
            records[fits, i] = chunk.data[at[fits] + i]
        for i in range(BEFORE):
            fits = before > i
            records[fits, WIDTH + i] = chunk.data[at[fits] - 1 - i]
        records[:, -2], records[:, -1] = before, behind
        order = multikey_order(as_words(records))
        in_order = records[order]
        new = np.r_[True, (in_order[1:] != in_order[:-1]).any(axis=1)] if len(order) else np.zeros(0, dtype=bool)
        self.at, self.doc = at, doc
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.records = in_order[new]
        #: The least doc_id that has the suffix in this chunk.
        self.least = np.full(len(self.records), _NO_ID)
        np.minimum.at(self.least, self.place, chunk.ids[doc])

    def leading(self) -> np.ndarray:
        return np.ascontiguousarray(self.records[:, :SEED]).view(f"S{SEED}").ravel()


def as_words(records: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers in the same order."""
    n, width = records.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = records
    return padded.view(">u8").astype(np.uint64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows by multikey quicksort: each word sorts only what the words before leave equal."""
    order = np.arange(len(words))
    open_, group = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    for j in range(words.shape[1]):
        if not len(open_):
            break
        key = words[order[open_], j]
        by = np.lexsort((key, group))
        order[open_] = order[open_[by]]
        key, group = key[by], group[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        open_, group = open_[tied], group[tied]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and how many leading bytes each has in common with the one before."""
    order = multikey_order(as_words(rows))
    in_order = rows[order]
    differs = np.ones((len(rows), rows.shape[1] + 1), dtype=bool)
    if len(rows):
        differs[1:, :-1] = in_order[1:] != in_order[:-1]
        differs[0, 0] = True
    return order, differs.argmax(axis=1)


def _class_ids(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    ids = np.empty(len(order), dtype=np.int64)
    ids[order] = np.cumsum(common < depth)
    return ids


def least_ids(records: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of bytes before the anchor: the suffixes that have such a string, and the
    least of ``ids`` with that string."""
    before, behind = records[:, -2].astype(np.int64), records[:, -1].astype(np.int64)
    forward = _classes(records[:, :WIDTH])
    backward = _classes(records[:, WIDTH : WIDTH + BEFORE])
    for r in range(BEFORE + 1):
        valid = np.flatnonzero((before >= r) & (behind >= WIDTH - r))
        if not len(valid):
            continue
        both = _class_ids(*forward, WIDTH - r)[valid] * (len(records) + 1) + _class_ids(*backward, r)[valid]
        _, place = np.unique(both, return_inverse=True)
        least = np.full(place.max() + 1, _NO_ID)
        np.minimum.at(least, place, ids[valid])
        yield r, valid, least[place]


def valid_mask(records: np.ndarray) -> np.ndarray:
    """As bits, the offsets at which a suffix has a string inside its document."""
    out = np.zeros(len(records), dtype=np.uint32)
    for r in range(BEFORE + 1):
        fits = (records[:, -2] >= r) & (records[:, -1] >= WIDTH - r)
        out |= fits.astype(np.uint32) << np.uint32(r)
    return out


# --- jobs ------------------------------------------------------------------------------


def _chunks(docs: DataFrame) -> DataFrame:
    """``chunk``, ``bytes`` and ``blob``: the rows of ``docs`` in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part, texts in pieces(batches, CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c.take(pa.array(range(len(c))))]) for c in part.columns], schema=part.schema
                ))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()),
                "bytes": pa.array([sum(map(len, texts))], pa.int64()),
                "blob": pa.array([_packed(sink.getvalue())], pa.binary()),
            })
            number += 1

    return docs.mapInArrow(run, "chunk bigint, bytes bigint, blob binary")


def _each(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the values of each row, one at a time, yielding dictionaries of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = {n: batch.column(n)[i] for n in batch.schema.names}
                for columns in work(values):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 4), dtype="<u2")
    out[:, :3] = np.frombuffer(data, dtype="<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _in_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """For ascending 48-bit keys, the place where each bucket begins, and the end."""
    borders = np.array([(i << 48) // buckets for i in range(buckets)], dtype=np.uint64)
    return np.r_[np.searchsorted(keys, borders), len(keys)]


def _repeated_keys(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk`` and ``seen``: for each bucket which of the chunk's keys other chunks have, as bits."""

    def send(row: dict) -> Iterator[dict]:
        keys, _, _ = Chunk(row["blob"].as_py()).keys()
        cuts = _in_buckets(keys, buckets)
        full = np.flatnonzero(np.diff(cuts))
        yield {
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array(np.full(len(full), row["chunk"].as_py()), pa.int64()),
            "keys": pa.array([_six(keys[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
        }

    def compare(group: pa.Table) -> pa.Table:
        sent = [k.as_py() for k in group.column("keys")]
        cuts = np.cumsum([len(k) // 6 for k in sent])[:-1]
        held = _from_six(b"".join(sent))
        order = np.argsort(held)
        held = held[order]
        same = held[1:] == held[:-1]
        often = np.zeros(len(order), dtype=bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(often, cuts)]
        return pa.table({
            "chunk": group.column("chunk"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary()),
        })

    sent = _each(chunks, send, "bucket bigint, chunk bigint, keys binary")
    compared = sent.groupBy("bucket").applyInArrow(compare, "chunk bigint, bucket bigint, bits binary")
    return compared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("seen"))


def _chosen(chunk: Chunk, seen: list[dict] | None, buckets: int) -> np.ndarray:
    """Which anchors have a hash that another document has."""
    keys, place, here = chunk.keys()
    often = here.copy()
    cuts = _in_buckets(keys, buckets)
    for answer in seen or []:
        low, high = cuts[answer["bucket"]], cuts[answer["bucket"] + 1]
        often[low:high] |= np.unpackbits(np.frombuffer(answer["bits"], dtype=np.uint8), count=high - low).astype(bool)
    return often[place]


_SUFFIXES = "chunk bigint, records binary, least binary, sample array<binary>"


def _all_suffixes(chunks: DataFrame, buckets: int) -> DataFrame:
    def work(row: dict) -> Iterator[dict]:
        chunk = Chunk(row["blob"].as_py())
        suffixes = chunk.suffixes(_chosen(chunk, row["seen"].as_py(), buckets))
        sample = [bytes(x) for x in suffixes.leading()[SAMPLED // 2 :: SAMPLED]]
        yield {
            "chunk": pa.array([row["chunk"].as_py()], pa.int64()),
            "records": pa.array([_packed(suffixes.records.tobytes())], pa.binary()),
            "least": pa.array([_packed(suffixes.least.tobytes())], pa.binary()),
            "sample": pa.array([sample], pa.list_(pa.binary())),
        }

    return _each(chunks, work, _SUFFIXES)


def _splitters(suffixes: DataFrame, buckets: int) -> np.ndarray:
    """The leading bytes at which buckets begin, ``buckets - 1`` of them at most.

    The sample is sorted and cut by Spark; only the splitters reach the driver.
    """
    sample = suffixes.select(F.explode("sample").alias("token"))
    counted = sample.groupBy("token").agg(F.count("*").alias("n"))
    ordered = counted.repartitionByRange(F.col("token")).withColumn("_part", F.spark_partition_id())
    placed = stage(ordered, "sample")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum("n").alias("n")).collect()}
    earlier, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(earlier)]
        earlier += sizes[part]
    if not earlier:
        return np.array([], dtype=f"S{SEED}")
    step = max(1.0, earlier / buckets)
    # The place of each token's last suffix in the whole sample.
    running = F.sum("n").over(Window.partitionBy("_part").orderBy("token"))
    last = F.element_at(F.create_map(*offsets), F.col("_part")) + running
    cut = placed.select("token", "n", last.alias("last"))
    rows = cut.filter(F.floor(F.col("last") / step) > F.floor((F.col("last") - F.col("n")) / step)).select("token").collect()
    return np.array(sorted(bytes(r.token) for r in rows), dtype=f"S{SEED}")


def _masks(suffixes: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``chunk`` and ``masks``: for each bucket the strings of the chunk's suffixes to remove, as bits."""
    shared = suffixes.sparkSession.sparkContext.broadcast(splitters)

    def send(row: dict) -> Iterator[dict]:
        records = np.frombuffer(_unpacked(row["records"].as_py()), dtype=np.uint8).reshape(-1, _RECORD)
        least = np.frombuffer(_unpacked(row["least"].as_py()), dtype=np.int64)
        leading = np.ascontiguousarray(records[:, :SEED]).view(f"S{SEED}").ravel()
        bucket = np.searchsorted(shared.value, leading, side="right")
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
        ends = np.r_[cuts[1:], len(bucket)]
        yield {
            "bucket": pa.array(bucket[cuts], pa.int64()),
            "chunk": pa.array(np.full(len(cuts), row["chunk"].as_py()), pa.int64()),
            "records": pa.array([_packed(records[a:b].tobytes()) for a, b in zip(cuts, ends)], pa.binary()),
            "least": pa.array([least[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        }

    def compare(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(_unpacked(x.as_py()), dtype=np.uint8) for x in group.column("records")]
        records = np.concatenate(parts).reshape(-1, _RECORD)
        ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("least")])
        order = multikey_order(as_words(records))
        in_order = records[order]
        new = np.r_[True, (in_order[1:] != in_order[:-1]).any(axis=1)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        distinct = in_order[new]
        least = np.full(len(distinct), _NO_ID)
        np.minimum.at(least, place, ids)
        mask = np.zeros(len(records), dtype=np.uint32)
        for r, valid, first in least_ids(distinct, least):
            of_all = np.full(len(distinct), _NO_ID)
            of_all[valid] = first
            mask |= (of_all[place] < ids).astype(np.uint32) << np.uint32(r)
        cuts = np.cumsum([len(p) // _RECORD for p in parts])[:-1]
        return pa.table({
            "chunk": group.column("chunk"), "bucket": group.column("bucket"),
            "mask": pa.array([x.tobytes() for x in np.split(mask, cuts)], pa.binary()),
        })

    sent = _each(suffixes, send, "bucket bigint, chunk bigint, records binary, least binary")
    compared = sent.groupBy("bucket").applyInArrow(compare, "chunk bigint, bucket bigint, mask binary")
    return compared.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))


def covered(chunk: Chunk, suffixes: Suffixes, mask: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk are removed, given the mask of each distinct suffix."""
    # Behind the chunk's first document with a suffix, every string of it repeats.
    later = chunk.ids[suffixes.doc] > suffixes.least[suffixes.place]
    whole = valid_mask(suffixes.records)
    bits = np.where(later, whole[suffixes.place], mask[suffixes.place])
    starts = np.zeros(len(chunk.data), dtype=bool)
    for r in range(BEFORE + 1):
        starts[suffixes.at[(bits >> np.uint32(r)) & 1 == 1] - r] = True
    index = np.arange(len(starts))
    return index - np.maximum.accumulate(np.where(starts, index, -WIDTH)) < WIDTH


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` and ``kept`` in place of the text.

    ``docs`` has ``doc_id`` and ``text``; other columns pass through, those named like the new
    ones are replaced. ``spans`` are the maximal removed runs [start, end) in bytes of the
    text, ``kept`` the remaining bytes; as these can begin or end inside a character,
    ``as_text`` gives a text without such rests instead. A NULL text is empty. Rows with a NULL doc_id come after all others and not before each other; rows
    with the same doc_id do not count as earlier than one another. Texts below ``WIDTH``
    bytes are left as they are. An empty table gives no rows.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    names = [c for c in docs.columns if c not in new]
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in names if c != "text")
    out += ", n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept " + ("string" if as_text else "binary")
    plain = docs.select(*[F.col(c).cast("bigint").alias(c) if c == "doc_id" else F.col(c) for c in names])
    out = out.replace(f"`doc_id` {kinds['doc_id']}", "`doc_id` bigint")
    chunks = stage(_chunks(plain), "chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, key_buckets = (max(least, -(-total // size)) for size in (BUCKET_BYTES, KEY_BUCKET_BYTES))
    seen = stage(_repeated_keys(chunks.select("chunk", "blob"), key_buckets), "seen")
    known = chunks.select("chunk", "blob").join(seen, "chunk", "left")
    suffixes = stage(_all_suffixes(known, key_buckets), "suffixes")
    masks = _masks(suffixes.drop("sample"), _splitters(suffixes, buckets))
    masks = stage(masks, "masks")

    def finish(row: dict) -> Iterator[dict]:
        chunk = Chunk(row["blob"].as_py())
        suffixes = chunk.suffixes(_chosen(chunk, row["seen"].as_py(), key_buckets))
        answers = b"".join(a["mask"] for a in row["masks"].as_py() or [])
        gone = covered(chunk, suffixes, np.frombuffer(answers, dtype=np.uint32))
        edges = np.diff(np.r_[False, gone, False].astype(np.int8))
        # A run ends where its document ends, even if the next one begins with a run.
        begins = np.union1d(np.flatnonzero(edges == 1), [e for e in chunk.ends[:-1] if 0 < e < len(gone) and gone[e] and gone[e - 1]])
        stops = np.union1d(np.flatnonzero(edges == -1), [e for e in chunk.ends[:-1] if 0 < e < len(gone) and gone[e] and gone[e - 1]])
        owner = np.searchsorted(chunk.ends, begins, side="right")
        first = chunk.ends - chunk.sizes
        spans: list[list[dict]] = [[] for _ in range(len(chunk.ids))]
        for d, a, b in zip(owner.tolist(), begins.tolist(), stops.tolist()):
            spans[d].append({"start": int(a - first[d]), "end": int(b - first[d])})
        kept = [chunk.data[a:b][~gone[a:b]].tobytes() for a, b in zip(first, chunk.ends)]
        removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
        rest = {n: chunk.rows.column(n) for n in names if n != "text"}
        yield rest | {
            "n_bytes": pa.array(chunk.sizes), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        }

    return _each(known.join(masks, "chunk", "left"), finish, out)
