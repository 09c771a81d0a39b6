"""Language identification by interpolated Kneser-Ney character models.

A text is its lower-case words, each between two spaces; anything that is no letter ends a word.
One model per language gives every character its probability after up to ``ORDER - 1``
characters of the same word, with absolute discounting, interpolation down to a uniform
distribution and continuation counts below the full context. Tables are kept in arrays
sorted by n-gram hash with one column per language. The language with the lowest
cross-entropy per character is chosen, and rejected when that is higher than nearly all
calibration texts of that language and length have it.

Models are fitted on a bounded sample of the labelled rows: the expected number of
characters per language is ``SAMPLE_CHARS``, drawn as small pieces of all distinct texts.
Limits and score are calibrated on all rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.texts import pieces

ORDER = 5
#: The uniform distribution that all models end in.
ALPHABET = 2048
SAMPLE_CHARS = 2_000_000
#: The sample is drawn by pieces of so many characters, a little moved to where a word ends.
PIECE_CHARS = 1000
UNKNOWN = "und"
#: Share of a language's own texts that calibration lets go, and the slack on top.
REJECTED, SLACK = 0.001, 1.25
#: Texts that a limit rests on at least; thinner length classes are pooled with their neighbours.
LEAST_TEXTS = 1000
#: Length classes, from 0; no string is longer than the last.
CLASSES = 16
#: Characters that count as independent when entropies become a score; the best is fitted.
EFFECTIVE = (1, 2, 5, 10, 20, 50)
#: Longer texts are scored in parts, cut at a space where there is one.
PART_CHARS = 1 << 20
_A = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_hash(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * _A + ord(c) + 1) & _U64
    return h


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, words between single spaces, and the text that each belongs to."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lower), dtype=np.int64, count=len(lower))
    joined = " ".join(lower) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = ~letters()[codes]
    codes = np.where(space, np.uint32(32), codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    if len(keep):
        keep[0] = not space[0]
    codes, owner = codes[keep], owner[keep]
    # A leading space; the space that ends a text also begins the next one.
    return np.concatenate([np.array([32], dtype=np.uint32), codes]), np.concatenate([[-1], owner]).astype(np.int64)


def words_in(text: str) -> list[str]:
    codes, _ = _codes([text])
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" ")


def fit_language(words: dict[str, int], order: int = ORDER) -> dict[str, tuple[float | None, float | None]]:
    """For each n-gram the log-probability of its last character after the others, and for
    each context the log of the mass it leaves to shorter ones."""
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        s = f" {word} "
        for i in range(1, len(s)):
            m = min(order, i + 1)
            counts[m][s[i - m + 1 : i + 1]] += n
    for m in range(order, 1, -1):
        for gram in counts[m]:
            counts[m - 1][gram[1:]] += 1
    out: dict[str, list[float | None]] = defaultdict(lambda: [None, None])
    below: dict[str, float] = {}
    for m in range(1, order + 1):
        total, kinds = Counter(), Counter()
        for gram, n in counts[m].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        once = sum(n == 1 for n in counts[m].values())
        pairs = sum(n == 2 for n in counts[m].values())
        discount = once / (once + 2 * pairs) if once and pairs else 0.5
        now = {}
        for gram, n in counts[m].items():
            context = gram[:-1]
            left = discount * kinds[context] / total[context]
            shorter = below[gram[1:]] if m > 1 else 1 / ALPHABET
            now[gram] = (n - discount) / total[context] + left * shorter
            out[gram][0] = math.log(now[gram])
        for context in total:
            out[context][1] = math.log(discount * kinds[context] / total[context])
        below = now
    return {gram: tuple(v) for gram, v in out.items()}


class Models:
    """The models of all languages, in arrays sorted by n-gram hash."""

    def __init__(self, fitted: dict[str, dict[str, tuple[float | None, float | None]]], order: int = ORDER):
        self.languages = sorted(fitted)
        self.order = order
        tables = [fitted[name] for name in self.languages]
        none = (None, None)
        empty = np.array([t.get("", none)[1] or 0.0 for t in tables], dtype=np.float32)
        self.floor = empty + np.float32(-math.log(ALPHABET))
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        shorter: dict[str, np.ndarray] = {}
        for m in range(1, order + 1):
            left = {
                g: np.array([t.get(g, none)[1] or 0.0 for t in tables], dtype=np.float32)
                for g in {g for t in tables for g, v in t.items() if len(g) == m - 1 and v[1] is not None}
            }
            now = {}
            for g in {g for t in tables for g, v in t.items() if len(g) == m and v[0] is not None}:
                back = left.get(g[:-1], 0.0) + shorter[g[1:]] if m > 1 else self.floor
                own = [t.get(g, none)[0] for t in tables]
                now[g] = np.array([b if p is None else p for p, b in zip(own, back)], dtype=np.float32)
            self.grams.append(self._sorted(now))
            self.contexts.append(self._sorted(left))
            shorter = now

    def _sorted(self, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.fromiter((gram_hash(g) for g in table), dtype=np.uint64, count=len(table))
        rows = np.array(list(table.values()), dtype=np.float32).reshape(len(table), len(self.languages))
        at = np.argsort(hashes)
        return hashes[at], rows[at]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored in each text, and nats per character under each language (inf without any)."""
        n_texts, n_languages = len(texts), len(self.languages)
        sums, sizes = np.zeros((n_texts, n_languages)), np.zeros(n_texts, dtype=np.int64)
        for owners, part in _parts(texts):
            codes, at = _codes(part)
            rows, log_p = self._log_p(codes)
            if len(rows):
                owner = np.asarray(owners)[at[rows]]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                np.add.at(sums, owner[starts], np.add.reduceat(log_p, starts, axis=0, dtype=np.float64))
                np.add.at(sizes, owner[starts], np.diff(np.r_[starts, len(owner)]))
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(sizes[:, None] > 0, -sums / sizes[:, None], np.inf)
        return sizes, entropy

    def _log_p(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions that are predicted, and the log-probabilities of each."""
        n = len(codes)
        index = np.arange(n)
        spaces = np.maximum.accumulate(np.where(codes == 32, index, -1))
        behind = np.empty(n, dtype=np.int64)  # the last space before each position
        behind[0], behind[1:] = 0, spaces[:-1]
        length = np.minimum(index - behind + 1, self.order)
        rows = np.flatnonzero((index > 0) & ((codes != 32) | (length > 2)))
        hashes = [np.zeros(n, dtype=np.uint64)]
        plain = codes.astype(np.uint64) + np.uint64(1)
        for _ in range(self.order):
            longer = plain.copy()
            longer[1:] += hashes[-1][:-1] * np.uint64(_A)
            hashes.append(longer)
        out = np.zeros((len(rows), len(self.languages)), dtype=np.float32)
        orders = length[rows]
        for m in range(self.order, 0, -1):
            here = np.flatnonzero(orders == m)
            if not len(here):
                continue
            found, values = _lookup(self.grams[m - 1], hashes[m][rows[here]])
            out[here[found]] += values
            lost = here[~found]
            if not len(lost):
                continue
            known, values = _lookup(self.contexts[m - 1], hashes[m - 1][rows[lost] - 1])
            if m > 1:
                out[lost[known]] += values
                orders[lost] = m - 1
            else:
                out[lost] += self.floor
        return rows, out


def _lookup(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = table
    if not len(hashes):
        return np.zeros(len(asked), dtype=bool), rows
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    found = hashes[at] == asked
    return found, rows[at[found]]


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``PART_CHARS``; longer ones in parts."""
    owners, group, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            stop = at + PART_CHARS
            if stop < len(text):
                cut = text.rfind(" ", at, stop)
                stop = cut + 1 if cut > at else stop
            owners.append(i)
            group.append(text[at:stop])
            size += stop - at
            at = stop
            if size >= PART_CHARS:
                yield owners, group
                owners, group, size = [], [], 0
    if group:
        yield owners, group


def _bin(n: Column) -> Column:
    """Length classes: each is four times as long as the one before."""
    return F.floor(F.log2(F.greatest(n, F.lit(1))) / 2).cast("int")


class Identifier:
    """Fitted models, calibrated; see :func:`fit`."""

    def __init__(self, models: Models, effective: int, limits: dict[tuple[str, int], float]):
        self.models, self.effective, self.limits = models, effective, limits

    def predict(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """``docs`` (text and others) with ``lang_pred``, ``score``, ``cross_entropy``, ``n_scored``, ``rejected``.

        ``und``, score 0, rejected, for NULL texts and texts without letters. Ties go to the first
        language in alphabetical order. Columns of these names are replaced, and the text
        is only kept if asked for.
        """
        new = ["lang_pred", "score", "cross_entropy", "n_scored"]
        kept = [c for c in docs.columns if c not in (*new, "rejected")]
        passed = [c for c in kept if keep_text or c != "text"]
        shared = docs.sparkSession.sparkContext.broadcast((self.models, self.effective))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, effective = shared.value
            names = np.array([*models.languages, UNKNOWN], dtype=object)
            for part, texts in pieces(batches):
                sizes, entropy = models.entropies(texts)
                known = sizes > 0
                if not models.languages:
                    known[:] = False
                    entropy = np.full((len(texts), 1), np.inf)
                best = entropy.argmin(axis=1)
                lowest = entropy[np.arange(len(best)), best]
                with np.errstate(invalid="ignore"):
                    odds = np.exp(-effective * (entropy - lowest[:, None])).sum(axis=1)
                rest = part.select(passed)
                columns = [
                    pa.array(names[np.where(known, best, -1)], pa.string()),
                    pa.array(np.where(known, 1 / odds, 0.0)),
                    pa.array(np.where(known, lowest, 0.0), mask=~known),
                    pa.array(sizes),
                ]
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, *new])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in passed)
        schema = ", ".join(x for x in (kinds, "lang_pred string, score double, cross_entropy double, n_scored bigint") if x)
        scored = docs.select(*kept).mapInArrow(run, schema)
        too_high = F.lit(False)
        if self.limits:
            by_class = {name: [self.limits.get((name, c)) for c in range(CLASSES)] for name, _ in self.limits}
            table = F.create_map(*[
                x for name, found in sorted(by_class.items()) for x in (F.lit(name), F.array(*[F.lit(v).cast("double") for v in found]))
            ])
            limit = F.get(F.element_at(table, F.col("lang_pred")), _bin(F.col("n_scored")))
            too_high = F.coalesce(F.col("cross_entropy") > limit, F.lit(False))
        return scored.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | too_high)


def pools(counts: dict[int, int], least: int = LEAST_TEXTS) -> dict[int, tuple[int, int]]:
    """For each length class the first and last class whose texts give its limit.

    Neighbours join on both sides until there are ``least`` texts, or all of the language.
    """
    out = {}
    for c in range(CLASSES):
        low = high = c
        while sum(counts.get(i, 0) for i in range(low, high + 1)) < least and (low > 0 or high < CLASSES - 1):
            low, high = max(low - 1, 0), min(high + 1, CLASSES - 1)
        out[c] = low, high
    return out


def borders(text: str, at: int) -> tuple[int, int]:
    """Where a piece begins and ends: at the first character that is no letter, if there is one within a piece."""

    def moved(place: int) -> int:
        if place <= 0 or place >= len(text):
            return min(place, len(text))
        for i in range(place, min(place + PIECE_CHARS, len(text))):
            if not text[i].isalpha():
                return i
        return place

    return moved(at * PIECE_CHARS), moved((at + 1) * PIECE_CHARS)


def _sample(rows: DataFrame, chars: int) -> DataFrame:
    """About ``chars`` characters of each language, as ``lang`` and ``text``, or all that it has.

    Texts are cut into pieces that are drawn by a hash of the whole text and their place, so
    that long texts give a part and copies of a text count once.
    """
    keyed = rows.select("lang", "text", F.xxhash64("text").alias("_key"), F.char_length("text").alias("_n"))
    once = keyed.groupBy("lang", "_key").agg(F.max("_n").cast("long").alias("n"))
    totals = once.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    shares = [x for r in totals for x in (F.lit(r.lang), F.lit(chars / max(r.n, 1)))]
    if not shares:
        return rows
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    number = F.ceil(F.col("_n") / PIECE_CHARS).cast("int")
    part = lambda i: F.pmod(F.xxhash64(F.col("_key"), i), F.lit(1 << 30)) / (1 << 30)
    drawn = keyed.filter("_n > 0").withColumn(
        "_drawn", F.filter(F.sequence(F.lit(0), number - 1), lambda i: part(i) < share)
    )

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "_key", "_at", "text"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            names, keys, places = (batch.column(c).to_pylist() for c in ("lang", "_key", "_drawn"))
            rows, size = [], 0
            for name, key, text, wanted in zip(names, keys, texts, places):
                for i in wanted:
                    low, high = borders(text, i)
                    rows.append((name, key, i, text[low:high]))
                    size += high - low
                    if size >= PART_CHARS:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)

    taken = drawn.filter(F.size("_drawn") > 0).select("lang", "text", "_key", "_drawn")
    taken = taken.mapInArrow(take, "lang string, _key bigint, _at int, text string")
    return taken.dropDuplicates(["lang", "_key", "_at"]).select("lang", "text")


def fit(labelled: DataFrame, calibration: DataFrame, sample_chars: int = SAMPLE_CHARS, order: int = ORDER) -> Identifier:
    """Fit on ``labelled`` and calibrate on ``calibration``, both with ``lang`` and ``text``.

    Rows with a NULL language or text are left out. Without any labels every text is ``und``.
    What reaches the driver is bounded by the sample and the number of languages. All
    rows of ``calibration`` are scored. Every class of every language gets a limit; a
    language without a text there takes the highest of the others.
    """
    usable = lambda df: df.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            counted: Counter = Counter()
            for name, text in zip(part.column("lang").to_pylist(), texts):
                counted.update((name, w) for w in words_in(text) if w)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counted], pa.string()),
                    pa.array([k[1] for k in counted], pa.string()),
                    pa.array(list(counted.values()), pa.int64()),
                ],
                ["lang", "word", "n"],
            )

    def tables(group: pa.Table) -> pa.Table:
        words = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        fitted = fit_language(words, order)
        return pa.table({
            "lang": pa.array([group.column("lang")[0].as_py()] * len(fitted), pa.string()),
            "gram": pa.array(list(fitted), pa.string()),
            "log_p": pa.array([v[0] for v in fitted.values()], pa.float64()),
            "log_left": pa.array([v[1] for v in fitted.values()], pa.float64()),
        })

    words = _sample(usable(labelled), sample_chars).mapInArrow(count, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.groupBy("lang").applyInArrow(tables, "lang string, gram string, log_p double, log_left double")
    fitted: dict = defaultdict(dict)
    for row in grams.toLocalIterator():
        fitted[row.lang][row.gram] = (row.log_p, row.log_left)
    models = Models(fitted, order)
    plain = Identifier(models, 1, {})
    if not models.languages:
        return plain
    wanted = F.array(*[F.lit(name) for name in models.languages])
    entropies = _entropies(usable(calibration), models)
    entropies = stage(entropies.filter("n > 0").withColumn("at", F.array_position(wanted, F.col("lang"))).filter("at > 0"), "calibration")
    own = F.element_at("entropies", F.col("at").cast("int"))
    loss = lambda e: F.log(F.aggregate(
        "entropies", F.lit(0.0), lambda a, h: a + F.exp((own - h) * e)
    ))
    losses = entropies.agg(*[F.avg(loss(e)).alias(f"e{e}") for e in EFFECTIVE]).first()
    effective = min(EFFECTIVE, key=lambda e: losses[f"e{e}"] if losses[f"e{e}"] is not None else 0.0)
    right = entropies.filter(own == F.array_min("entropies"))
    right = right.select("lang", _bin(F.col("n")).alias("length"), own.alias("own"))
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in right.groupBy("lang", "length").count().collect():
        counts[r.lang][r.length] = r["count"]
    pooled = {name: pools(found) for name, found in counts.items()}
    if not pooled:
        return Identifier(models, effective, {})
    # The classes that a text helps to give a limit: its own, and thin ones nearby.
    helped = F.create_map(*[
        x
        for name, ranges in pooled.items()
        for x in (F.lit(name), F.array(*[
            F.array(*[F.lit(c) for c, (low, high) in ranges.items() if low <= i <= high]).cast("array<int>") for i in range(CLASSES)
        ]))
    ])
    spread = right.withColumn("length", F.explode(F.get(F.element_at(helped, F.col("lang")), F.col("length"))))
    found = spread.groupBy("lang", "length").agg(F.percentile_approx("own", 1 - REJECTED, 10_000).alias("limit"))
    limits = {(r.lang, r.length): r.limit * SLACK for r in found.collect()}
    highest = {c: max(v for (_, at), v in limits.items() if at == c) for c in range(CLASSES)}
    for name in set(models.languages) - set(pooled):
        limits |= {(name, c): v for c, v in highest.items()}
    return Identifier(models, effective, limits)


def _entropies(rows: DataFrame, models: Models) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            sizes, entropy = shared.value.entropies(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array(sizes), pa.array(list(entropy), pa.list_(pa.float64()))],
                ["lang", "n", "entropies"],
            )

    return rows.mapInArrow(run, "lang string, n bigint, entropies array<double>")
