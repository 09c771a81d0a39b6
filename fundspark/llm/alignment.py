"""Alignment of two tokenizers over every text, once per distinct text.

The texts are shuffled as a whole, so that each distinct one is tokenised and aligned once and
carries its multiplicity. Both tokenizers start a new token at a single space between two other
characters: a byte-level BPE splits there before it merges, and the pieces of the other one hold
no space after another character (checked when it is loaded). A text is therefore the sequence
of its runs between such spaces, and each distinct run is encoded once per worker. Texts go in
chunks; of a chunk only its distinct id pairs with their weighted counts are shuffled. The
corpus-wide counts come back to the chunk, which holds its runs by number, and become measures
of its texts, which are joined to the doc_ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.packing import _plain, byte_characters
from fundspark.llm.texts import pieces

#: Text bytes of a chunk, and characters of a longer text that are split into runs at once.
CHUNK_BYTES = 4 << 20
SEGMENT_CHARS = 1 << 20
# How this byte-level BPE splits a text, and its token that texts do not give.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {b"<|endoftext|>"}
#: A space that stands alone between two other characters.
BORDER = re.compile(r"(?<=\S) (?=\S)")
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
COUNTS = MEASURES[:4]
CHUNK = (
    "chunk bigint, keys array<binary>, " + ", ".join(f"{c} array<bigint>" for c in COUNTS)
    + ", groups array<string>, runs array<binary>, sizes binary, links binary, "
    "pairs array<struct<pair: bigint, n: bigint>>"
)
MEASURED = "key binary, " + ", ".join(f"{c} bigint" for c in MEASURES) + ", groups_sha256 string"


class Aligner(dict):
    """What both tokenizers make of a run, by its text; None where B's tokens do not give it back.

    Two generations of ``LIMIT`` runs are kept, so that the frequent ones stay. A byte-level
    BPE gives back every text. Its file's vocabulary, in which a token's id is the rank of its
    merge, and its pattern are handed to a faster implementation of the same method.
    """

    LIMIT = 400_000

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.old: dict[str, tuple] = {}
        of = {c: b for b, c in byte_characters().items()}
        vocabulary = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=False)
        tokens = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if all(c in of for c in t)}
        ordinary = {t: i for t, i in tokens.items() if t not in SPECIAL}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ordinary, special_tokens={}).encode_ordinary
        self.a_sizes = [0] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.a_sizes[i] = len(token)
        second = SentencePieceProcessor(model_file=b_path)
        self.b = second.encode
        spelled = [second.id_to_piece(i) for i in range(second.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in spelled):
            raise ValueError("a piece of the second tokenizer reaches over a space")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)
        ]
        self.a_sizes, self.b_sizes = np.array(self.a_sizes), np.array([len(p) for p in self.b_bytes])
        most = max(len(self.a_sizes), len(self.b_sizes))
        #: An id as text after each of the marks that may come before it.
        self.shown = [[f"{mark}{i}" for i in range(most)] for mark in (",", "|", ";", "")]

    def __missing__(self, run: str) -> tuple | None:
        return self.old[run]

    def whole(self, pieces: Iterable[list[int]], wanted: bytes) -> bool:
        """Whether B's tokens give back these bytes."""
        return b"".join([self.b_bytes[i] for i in chain.from_iterable(pieces)]) == wanted

    def learn(self, runs: list[str]) -> None:
        """Encode and align runs that are not known, all in one go."""
        if len(self) > self.LIMIT:
            self.old = dict(self)
            self.clear()
        kept = [run for run in runs if run in self.old]
        self.update((run, self.old[run]) for run in kept)
        new = [run for run in runs if run not in self.old] if kept else runs
        if not new:
            return
        second = self.b(new, num_threads=1)
        spelled = [b" " + run.encode() for run in new]
        ends = [np.cumsum(list(map(len, x))) for x in (second, spelled)]
        bytes_ = np.r_[0, np.cumsum(self.b_sizes[np.fromiter(chain.from_iterable(second), dtype=np.int64)])]
        if not np.array_equal(bytes_[ends[0]], ends[1]) or not self.whole(second, b"".join(spelled)):
            good = [self.whole([ids], wanted) for ids, wanted in zip(second, spelled)]
            self.update((run, None) for run, fine in zip(new, good) if not fine)
            new, second, spelled = ([x for x, fine in zip(xs, good) if fine] for xs in (new, second, spelled))
        if new:
            self.update(zip(new, self.aligned(new, second, np.array([len(x) for x in spelled]))))

    def aligned(self, runs: list[str], second: list[list[int]], sizes: np.ndarray) -> Iterator[tuple]:
        """Of each run: A tokens, B tokens, groups, the groups as text and the links as bytes.

        All runs lie one after the other. Between any two neighbouring ends of A or B tokens one
        token of each overlaps, and each such pair overlaps nowhere else.
        """
        a = np.array(self.a(" " + " ".join(runs)), dtype=np.int64)
        b = np.fromiter(chain.from_iterable(second), dtype=np.int64)
        ends_a, ends_b, ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
        every, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = a[np.searchsorted(ends_a, every)] << 32 | b[np.searchsorted(ends_b, every)]
        # Tokens by group, A's before B's, with the mark before each.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_a, first_b = (np.diff(g, prepend=-1) > 0 for g in (group_a, group_b))
        opens = np.isin(group_a, np.r_[0, np.searchsorted(common, ends)[:-1] + 1]) & first_a
        marks = np.r_[np.where(opens, 3, np.where(first_a, 2, 0)), np.where(first_b, 1, 0)]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        shown = self.shown
        parts = [shown[m][i] for m, i in zip(marks[order].tolist(), np.r_[a, b][order].tolist())]
        to = [np.searchsorted(x, ends, side="right") for x in (ends_a, ends_b, common, every)]
        counts = [np.diff(x, prepend=0).tolist() for x in to[:3]]
        last_part, last_link, held = (to[0] + to[1]).tolist(), to[3].tolist(), links.tobytes()
        at = link = 0
        for n_a, n_b, n_groups, part, more in zip(*counts, last_part, last_link):
            yield n_a, n_b, n_groups, "".join(parts[at:part]), held[8 * link : 8 * more]
            at, link = part, more


_known: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The tokenizers in two files, with what this worker has aligned so far."""
    if (a_path, b_path) not in _known:
        _known[a_path, b_path] = Aligner(a_path, b_path)
    return _known[a_path, b_path]


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """A text cut at borders, about every ``size`` characters."""
    at = 0
    while len(text) - at > size and (found := BORDER.search(text, at + size)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 in as many bytes as the largest needs, all lowest bytes first: those behind
    them are mostly zeros, which compress."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    return sum(plane.astype(np.int64) << 8 * i for i, plane in enumerate(planes))


def runs_of(text: str) -> list[str]:
    """A segment cut at its borders."""
    return text.split(" ") if _plain(text) else BORDER.split(text)


class _Chunk:
    """The texts of a chunk, and their runs by number as they come."""

    def __init__(self, known: Aligner):
        self.known, self.numbers, self.found, self.groups = known, {}, [], []
        self.texts, self.pending, self.waiting, self.bytes = [], [], 0, 0

    def settled(self) -> list[tuple[bytes, int, np.ndarray, str]]:
        """Key, weight, runs and digest of the texts that have tokens."""
        self.settle()
        return [
            (key, weight, np.concatenate(parts), digest.hexdigest()) for key, weight, parts, digest in self.texts if parts
        ]

    def add(self, key: bytes, text: str, weight: int) -> None:
        self.texts.append((key, weight, [], hashlib.sha256()))
        for i, segment in enumerate(segments(text)):
            self.pending.append((len(self.texts) - 1, i, runs_of(segment)))
            self.waiting += len(segment)
            if self.waiting >= SEGMENT_CHARS:
                self.settle()
        self.bytes += len(text)

    def settle(self) -> None:
        """Number the runs of the segments that wait; the unknown ones are learnt together."""
        numbers, known, broken = self.numbers, self.known, set()
        new = [run for run in dict.fromkeys(chain.from_iterable(runs for *_, runs in self.pending)) if run not in numbers]
        if unknown := [run for run in new if run not in known]:
            known.learn(unknown)
        for run in new:
            found = known[run]
            numbers[run] = -1 if found is None else len(self.found)
            if found is not None:
                self.found.append(found)
                self.groups.append(found[3])
        for text, i, runs in self.pending:
            at = list(map(numbers.__getitem__, runs))
            _, _, parts, digest = self.texts[text]
            if text in broken or -1 in at or (i and not parts):
                # A run that does not come back leaves its text without tokens.
                broken.add(text)
                parts.clear()
                continue
            digest.update(((";" if i else "") + ";".join(map(self.groups.__getitem__, at))).encode())
            parts.append(np.array(at, dtype=np.uint32))
        self.pending, self.waiting = [], 0

    def batch(self, chunk: int) -> Iterator[pa.RecordBatch]:
        rows = self.settled()
        if not rows:
            return
        sizes = np.array([len(r[4]) // 8 for r in self.found], dtype=np.uint32)
        pairs, links = np.unique(np.frombuffer(b"".join([r[4] for r in self.found]), dtype=np.int64), return_inverse=True)
        runs = [at for _, _, at, _ in rows]
        each = np.repeat([w for _, w, _, _ in rows], [len(at) for at in runs])
        weighed = np.bincount(np.concatenate(runs), weights=each, minlength=len(sizes))
        counts = np.bincount(links, weights=np.repeat(weighed, sizes)).astype(np.int64)
        facts = {c: np.array([r[i] for r in self.found], dtype=np.int64) for i, c in enumerate(COUNTS[:3])}
        facts["n_links"] = sizes.astype(np.int64)
        columns = {
            "chunk": [chunk],
            "keys": pa.array([[k for k, _, _, _ in rows]], pa.list_(pa.binary())),
            **{c: pa.array([[int(v[at].sum()) for at in runs]], pa.list_(pa.int64())) for c, v in facts.items()},
            "groups": [[g for _, _, _, g in rows]],
            "runs": pa.array([[packed(at) for at in runs]], pa.list_(pa.binary())),
            "sizes": [packed(sizes)],
            "links": [packed(links)],
            "pairs": pa.ListArray.from_arrays([0, len(pairs)], pa.StructArray.from_arrays([pairs, counts], ["pair", "n"])),
        }
        yield pa.RecordBatch.from_pydict(columns)


def text_key(text: Column) -> Column:
    """The 256-bit digest that stands for a text once equal texts are one."""
    return F.unhex(F.sha2(text, 256))


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the distinct texts, aligned; texts without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, at = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        chunk = _Chunk(known)
        for part, texts in pieces(batches):
            for key, text, weight in zip(part.column("key").to_pylist(), texts, part.column("weight").to_pylist()):
                chunk.add(key, text, weight)
                if chunk.bytes >= chunk_bytes:
                    yield from chunk.batch(at)
                    chunk, at = _Chunk(known), at + 1
        yield from chunk.batch(at)

    distinct = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("weight"))
    return distinct.select(text_key(F.col("text")).alias("key"), "text", "weight").mapInArrow(run, CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (A id in the upper, B id in the lower 32 bits), its ``count`` over all texts and whether
    it is the highest of its B id (``best``)."""
    exploded = chunks.select(F.explode("pairs").alias("p"))
    counts = stage(exploded.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def measures(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """The measures of each distinct text by its ``key``."""
    wanted = chunks.select(F.col("chunk").alias("of"), F.explode("pairs.pair").alias("pair"))
    found = wanted.join(counts, "pair").groupBy("of")
    return chunks.drop("pairs").groupBy("chunk").cogroup(found).applyInArrow(_measured, MEASURED)


def _measured(chunk: pa.Table, found: pa.Table) -> pa.Table:
    # Pairs in ascending order are the chunk's pairs by number.
    order = np.argsort(found.column("pair").to_numpy())
    count = found.column("count").to_numpy()[order]
    best = found.column("best").to_numpy(zero_copy_only=False)[order]
    row = {c: chunk.column(c)[0].as_py() for c in chunk.column_names if c != "chunk"}
    sizes, links = unpacked(row["sizes"]), unpacked(row["links"])
    starts = np.cumsum(sizes) - sizes
    per_run = [np.add.reduceat(x.astype(np.int64)[links], starts) for x in (best, count)]
    runs = [unpacked(at) for at in row["runs"]]
    sums = [[int(x[at].sum()) for at in runs] for x in per_run]
    columns = [row["keys"], *(row[c] for c in COUNTS), *sums, row["groups"]]
    kinds = [pa.binary(), *[pa.int64()] * len(MEASURES), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", *MEASURES, "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id`` with the measures of its text's alignment.

    A is a byte-level BPE file, B a sentencepiece model; every executor has both under these paths.
    One row per row of ``docs``, also for repeated and NULL doc_ids. Texts that are NULL, empty,
    or whose tokens do not give back a space and the text have zeros and an empty digest. Equal
    texts have equal measures, and each counts for the pair counts. Other columns are ignored. A
    long text is split into runs a segment at a time; a run without a border inside is encoded
    whole. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    chunks = stage(aligned_chunks(docs, a_path, b_path, chunk_bytes), "aligned")
    measured = measures(chunks, pair_counts(chunks))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES]
    return keyed.join(measured, "key", "left").select(
        "doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
