"""Texts in Arrow batches: bounded pieces of work, and hashes of words and shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
SHINGLE = 5


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about ``limit`` bytes of the column ``text``, and their texts (NULL: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            used = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, used + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, [t or "" for t in part.column("text").to_pylist()]
            at = stop


class WordHashes(dict):
    """The 64-bit hash of a word as eight bytes, kept for words seen before."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        return found


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; a shorter text is one run, no words are none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def shingle_set(text: str, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of the lower-case words of a text."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split(), known), width))
