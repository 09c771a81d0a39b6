"""Bound-certified packing of token sequences.

Documents are tokenised, cut into pieces of at most ``capacity`` tokens, and dealt to partitions.
Each partition packs its pieces by best-fit decreasing and compares its bins with lower bounds
from dual feasible functions (Fekete and Schepers), which no packing of these pieces can beat;
where they are equal the partition is certified. One that is as good as full keeps all bins
but the least filled, which another partition may fill. The others, whose gaps other pieces
could close, keep only their full bins. The pieces given away are dealt anew to as many
partitions as they need and packed again, for a fixed number of rounds or until one
partition holds them all. No task gets more than its share of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.texts import pieces as text_pieces

CAPACITY = 2048
END_OF_TEXT = 0
#: Pieces dealt to a partition.
PARTITION_PIECES = 20_000
#: Pieces that are widened at once.
WIDENED_ROWS = 500
ROUNDS = 5
_STOPS = frozenset(".,;:!?")
_OTHER_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and i != 32]
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def byte_characters() -> dict[int, str]:
    """The character by which a byte-level BPE spells each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class ByteTokens(dict):
    """The ids of what follows a space as little-endian 32-bit bytes, the space included.

    Keyed by the run without its space, and kept for runs seen before.
    """

    LIMIT = 800_000

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.spelling = byte_characters()
        self.space = self.spelling[ord(" ")]
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

        self.stops = {c: self.encode(c) for c in (*_STOPS, "\n")}

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, letters: str, space: str) -> bytes:
        """A word of letters is one unit, which only the model has to see."""
        spelled = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.spelling)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(space + spelled)])

    def __missing__(self, run: str) -> bytes:
        """Words are encoded by themselves, also before a stop and on both sides of a line break."""
        head, line, tail = run.partition("\n")
        if run.isalpha():
            found = self.word(run, self.space)
        elif run[-1:] in _STOPS and run[:-1].isalpha():
            found = self[run[:-1]] + self.stops[run[-1]]
        elif line and tail.isalpha() and head and not head[-1].isspace():
            found = self[head] + self.stops[line] + self.word(tail, "")
        else:
            found = self.encode(" " + run)
        if len(self) > self.LIMIT:
            self.clear()
        self[run] = found
        return found


_known: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """The tokenizer in a file, with what this task has encoded so far."""
    if path not in _known:
        from tokenizers import Tokenizer

        _known[path] = ByteTokens(Tokenizer.from_file(path))
    return _known[path]


def _plain(text: str) -> bool:
    """Whether every space stands alone between two other characters, none of them white space."""
    if "  " in text or text[:1].isspace() or text[-1:].isspace():
        return False
    return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE)


def token_bytes(text: str, known: ByteTokens) -> bytes:
    """The ids of a text.

    A byte-level BPE of this kind never merges across the border before a single space
    between two other characters, so the text is encoded by such runs. A text with other
    spacing, or with what may be a special token, is encoded whole.
    """
    if "<|" in text or not _plain(text):
        return known.encode(text)
    runs = text.split(" ")
    return known.encode(runs[0]) + b"".join(map(known.__getitem__, runs[1:]))


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; in longer documents the first may be the shorter one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, narrow: bool = False) -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids``.

    ``ids`` holds the token ids as little-endian 32-bit numbers; with ``narrow`` as 16-bit ones where the
    vocabulary fits, for tables that are stored or shuffled before :func:`widened` undoes it. A
    NULL or empty text has the end-of-text id alone. ``path`` is the tokenizer's file, which
    every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_tokens(path)
        end = np.array([END_OF_TEXT], dtype="<u4").tobytes()
        short = narrow and known.tokenizer.get_vocab_size() <= 1 << 16
        for part, texts in text_pieces(batches):
            rows = []
            for key, text in zip(part.column("doc_id").to_pylist(), texts):
                ids = (token_bytes(text, known) if text else b"") + end
                size = 4
                if short:
                    ids, size = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes(), 2
                ids = memoryview(ids)
                for i, (start, length) in enumerate(cut(len(ids) // size, capacity)):
                    rows.append((key, i, start, length, bytes(ids[size * start : size * (start + length)])))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids"]
            )
        known.clear()  # the worker goes on to other tasks, also of other steps

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def widened(items: DataFrame) -> DataFrame:
    """``items`` with 32-bit ``ids``, whatever their width was; ``length`` tells how many there are."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, WIDENED_ROWS):
                batch = whole.slice(at, WIDENED_ROWS)
                ids = [
                    np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() if x is not None and len(x) == 2 * n else x
                    for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
                ]
                columns = [pa.array(ids, pa.binary()) if c == "ids" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return items.mapInArrow(run, items.schema)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs, given how many pieces there are of each length (index).

    The best of the total length and of the dual feasible functions u(k) and U(eps).
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((n * sizes).sum()) // capacity)
    # U(eps): what is over capacity - eps fills a bin, what is under eps counts for nothing.
    total, number = np.cumsum(n * sizes), np.cumsum(n)
    for eps in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - eps])
        middle = int(total[capacity - eps] - total[eps - 1])
        best = max(best, -(-(large * capacity + middle) // capacity))
    # u(k): lengths are rounded to multiples of a k-th, except those that divide evenly.
    for k in range(1, 33):
        grown = (k + 1) * sizes
        value = np.where(grown % capacity == 0, sizes * k, grown // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece by best-fit decreasing, bins numbered from 0.

    Open bins are kept by free space; a bit mask of the free spaces in use finds the least
    that fits. Pieces of the full capacity need no search.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, chosen = capacity, opened
            opened += 1
        bins[at] = chosen
        left = space - length
        if left:
            free[left].append(chosen)
            mask |= 1 << left
    return bins


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``items`` with ``sequence_id``, ``offset`` and ``certified``.

    ``items`` has a column ``length`` of 1 to ``capacity``; other columns pass through, but
    only lengths are dealt to partitions; the others are joined to their places. Pieces lie in a sequence one after the other from 0. ``certified`` tells that the partition which
    made the sequence used no more bins than any packing of its pieces needs. Which of
    several equal pieces goes where is open, the number of sequences is not. An empty
    table gives no rows.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "certified")]
    out = "_piece bigint, length bigint, sequence_id bigint, offset bigint, certified boolean, _done boolean"
    whole = stage(items.select(*names).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    moved = ["_piece", "length"]
    left = whole.select("_piece", F.col("length").cast("bigint").alias("length"))
    parts = max(1, -(-left.count() // partition_pieces))
    results = []
    for round_ in range(ROUNDS):
        last = parts == 1 or round_ == ROUNDS - 1
        run = _packer(moved, capacity, last, round_)
        deal = F.pmod(F.xxhash64(F.lit(round_), *moved), F.lit(parts)).cast("long")
        packed = stage(left.withColumn("_part", deal).groupBy("_part").applyInArrow(run, out), "packed")
        results.append(packed.filter("_done").drop("_done"))
        if last:
            break
        left = packed.filter("NOT _done").select(*moved)
        parts = max(1, -(-left.count() // partition_pieces))
    everything = results[0]
    for more in results[1:]:
        everything = everything.unionByName(more)
    return whole.join(everything.drop("length"), "_piece").select(*names, "sequence_id", "offset", "certified")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id`` and the ``ids`` of its pieces one after the other."""
    placed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"))
    joined = F.aggregate("_pieces", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return placed.select("sequence_id", joined.alias("ids"))


def _packer(names: list[str], capacity: int, last: bool, round_: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        part = group.column("_part")[0].as_py()
        bins = best_fit(lengths, capacity)
        used = int(bins.max()) + 1
        certified = used == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        keep = filled == capacity
        if last:
            keep[:] = True
        elif used == -(-int(lengths.sum()) // capacity):
            keep = keep | (np.arange(used) != filled.argmin())
        done = keep[bins]
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offsets = np.empty(len(bins), dtype=np.int64)
        offsets[order] = ends - lengths[order] - base
        ids = ((round_ << 56) | (part << 32)) + bins
        return pa.table(
            [*(group.column(c) for c in names), pa.array(ids), pa.array(offsets), pa.array(np.full(len(bins), certified)), pa.array(done)],
            [*names, "sequence_id", "offset", "certified", "_done"],
        )

    return run
