"""Groups of spelling variants by an index of variable-length grams (Li, Wang and Yang, VGRAM).

A dictionary of grams is built from the words: a gram goes on to longer ones only while it is
frequent. A word is decomposed into the longest gram at each place, without those inside another.
For every word the most of its grams that one edit can change is known, so that two words one
edit apart share at least the others; of the lists of its grams only the rarest have to be merged,
one more than an edit can change. What meets there at fitting places and lengths is verified.
Words of which an edit can change all grams go once more, among themselves, through a dictionary
of shorter grams, down to pairs of characters, of which some always remain.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.texts import pieces

#: A run whose checksum this number divides loses a character.
EDITED = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
SHORTEST = 2
#: Longest grams of the dictionaries, tried one after the other.
LEVELS = (5, 3, SHORTEST)
#: A gram is frequent above RARE words, and of each length at most FREQUENT grams are: the
#: dictionary has at most FREQUENT times the alphabet's size of grams of each length above two.
RARE, FREQUENT = 30, 5_000
START, END = "^", "$"

_letters = set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0xC0, 0x100))
_TABLE = bytes(b + 32 * (b < 0x5B) if b in _letters else 32 for b in range(256))
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def runs(text: str) -> list[bytes]:
    """The runs of letters in Latin-1, A-Z in lower case; what Latin-1 lacks is no letter here."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the edited runs of all texts, of so many code points and occurrences at least.

    A run's fate depends on its doc_id, which counts as an empty text where it is NULL; NULL texts
    have no runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            found = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([found, pa.array(counts.values(), pa.int64())], ["word", "n"])

        counts: Counter[bytes] = Counter()
        for part, texts in pieces(batches):
            for key, text in zip(part.column("doc_id").to_pylist(), texts):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(runs(text)).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % EDITED == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                    if len(word) >= least_chars:
                        counts[word] += n
            if len(counts) > HELD_WORDS:
                yield counted()
                counts.clear()
        yield counted()

    partial = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Grams:
    """A dictionary of grams with their frequencies, and what follows from it."""

    def __init__(self, grams: dict[str, int], longest: int, rare: int):
        self.grams, self.longest = grams, longest
        #: Grams that go on to longer ones, and what stands inside a gram after its first character.
        self.inner = {g for g, n in grams.items() if n > rare and len(g) < longest}
        self.inside = {g[i:j] for g in grams for i in range(1, len(g)) for j in range(i + 1, len(g) + 1)}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """First and last place of the kept grams, the word between a start and an end mark."""
        kept, reached = [], -1
        for p in range(len(word) - SHORTEST + 1):
            size = SHORTEST
            while size < min(self.longest, len(word) - p) and word[p : p + size] in self.inner and word[p : p + size + 1] in self.grams:
                size += 1
            if p + size - 1 > reached:
                reached = p + size - 1
                kept.append((p, reached))
        return kept

    def goes_on(self, part: str) -> bool:
        return len(part) < SHORTEST or part in self.inner

    def affected(self, word: str, kept: list[tuple[int, int]]) -> int:
        """The most kept grams that one edit between the marks can change.

        An edit changes the grams over its place; those before it from the first place on from
        where a dictionary path leads up to it, as they may grow; and those behind it that a new
        gram over the edit may swallow.
        """
        most = 0
        for i in range(1, len(word)):
            low = max(0, i - self.longest + 1)
            first = next((p for p in range(low, i) if self.goes_on(word[p:i])), i)
            changed = inserted = 0
            for p, e in kept:
                if e < i:
                    hit = p >= first
                    changed, inserted = changed + hit, inserted + hit
                elif p < i:
                    changed, inserted = changed + 1, inserted + 1
                else:
                    changed += p == i or word[i + 1 : e + 1] in self.inside
                    inserted += word[i : e + 1] in self.inside
            # The end mark is not edited, but something may be inserted before it.
            most = max(most, inserted, changed if i < len(word) - 1 else 0)
        return most

    def rarest(self, word: str) -> tuple[list[tuple[str, int]], int]:
        """The grams to be merged with their places, and how many grams every variant shares."""
        marked = f"{START}{word}{END}"
        kept = self.decompose(marked)
        affected = self.affected(marked, kept)
        ordered = sorted((self.grams[g], g, p) for p, g in ((p, marked[p : e + 1]) for p, e in kept))
        return [(g, p) for _, g, p in ordered[: affected + 1]], len(kept) - affected


def dictionary(vocabulary: DataFrame, longest: int, rare: int = RARE, frequent: int = FREQUENT) -> Grams:
    """The grams of up to ``longest`` characters.

    A gram is frequent if it occurs more than ``rare`` times and more than the words' total
    length over ``frequent`` times, so that at most ``frequent`` grams of each length are. Kept are the
    shortest grams and those whose part without the last character is frequent.
    """
    marked = F.concat(F.lit(START), "word", F.lit(END))
    total = vocabulary.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    least = max(rare, total // frequent)
    sizes = range(SHORTEST, longest + 1)
    cut = lambda size: F.transform(
        F.sequence(F.lit(1), F.length("m") - size + 1), lambda p: F.substring("m", p, F.lit(size))
    )
    several = F.flatten(F.array(*[
        F.when(F.length("m") >= size, cut(size)).otherwise(F.array().cast("array<string>")) for size in sizes
    ]))
    counts = stage(
        vocabulary.select(marked.alias("m")).select(F.explode(several).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")),
        "grams",
    )
    size = F.length("gram")
    # At most `frequent` of each length, so that they can be broadcast and the dictionary collected.
    often = counts.filter((F.col("n") > least) & (size < longest)).select(F.col("gram").alias("stem"))
    longer = counts.filter(size > SHORTEST).withColumn("stem", F.substring("gram", F.lit(1), size - 1))
    kept = counts.filter(size == SHORTEST).unionByName(longer.join(F.broadcast(often), "stem", "left_semi").drop("stem"))
    return Grams({r.gram: r.n for r in kept.collect()}, longest, least)


def _lists(vocabulary: DataFrame, grams: Grams) -> DataFrame:
    """The gram lists: ``gram, place, word, n, shared``."""
    held = vocabulary.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                rarest, shared = index.rarest(word)
                rows += [(g, p, word, n, shared) for g, p in rarest]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "place", "word", "n", "shared"]
            )

    return vocabulary.select("word", "n").mapInArrow(run, "gram string, place int, word string, n bigint, shared int")


def _met(lists: DataFrame) -> DataFrame:
    """Pairs of words one edit apart that meet in a list: ``a, b`` with their counts.

    The shorter word looks for equally long ones at its places, and for those longer by one at
    its places and the next.
    """
    size = F.length("word")
    there = lists.withColumn("size", size)
    steps = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(s).alias("shift")) for d, s in ((0, 0), (1, 0), (1, 1))])
    here = lists.withColumn("step", F.explode(steps)).select(
        "gram", (F.col("place") + F.col("step.shift")).alias("place"), (size + F.col("step.longer")).alias("size"),
        F.col("word").alias("a"), F.col("n").alias("n_a"),
    )
    there = there.select("gram", "place", "size", F.col("word").alias("b"), F.col("n").alias("n_b"))
    one = (F.levenshtein("a", "b", 1) == 1) & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    return here.join(there, ["gram", "place", "size"]).filter(one).select("a", "b", "n_a", "n_b")


def near_pairs(vocabulary: DataFrame, levels: tuple[int, ...] = LEVELS, rare: int = RARE, frequent: int = FREQUENT) -> DataFrame:
    """All pairs of words that differ by one inserted, deleted or replaced code point, once each."""
    left, found = vocabulary.select("word", "n"), []
    for i, longest in enumerate(levels):
        lists = stage(_lists(left, dictionary(left, longest, rare, frequent)), "lists")
        found.append(_met(lists))
        if i + 1 < len(levels):
            # Pairs of which neither word is sure to share a gram.
            left = stage(lists.filter("shared < 1").select("word", "n").distinct(), "unsure")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of every word with a ``form``: the end of its chain of forms.

    Counts at least double along a chain, so that the greatest count bounds its length and with it
    the rounds, each of which doubles the way that a word has come.
    """
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log2(max(most, 2)) + 1)))):
        after = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stage(found.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame, rare: int = RARE, frequent: int = FREQUENT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    A word's near words differ from it by one edit. Its form is the near word of the largest count,
    the first in code-point order among equals, if that is at least twice its own. NULL and empty
    texts give no words, repeated rows count each, other columns are ignored, and an empty
    table gives no rows. Long texts and long runs are taken whole.
    """
    vocabulary = stage(words(docs), "words")
    pairs = near_pairs(vocabulary, rare=rare, frequent=frequent)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best")
    )
    joined = vocabulary.join(best, "word", "left")
    strong = -F.col("best.minus") >= 2 * F.col("n")
    found = stage(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    formed = found.filter(F.col("form").isNotNull())
    most = found.agg(F.max("n")).first()[0] or 0
    return found.join(roots(formed, most), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
