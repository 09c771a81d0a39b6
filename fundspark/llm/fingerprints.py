"""SimHash fingerprints of 128 bits and a search by permuted block tables.

Terms are pairs of neighbouring words (single words in a one-word text), words being
separated by white space. Each occurrence of a term votes with the weight "length of the
term, at most 31": long words are rare ones. A bit is set when the weighted votes for it
exceed those against it. A text without words has the fingerprint 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 128
MAX_WEIGHT = 31
#: Bits i and i + 32 of a hash are counted in the two halves of one long.
_PAIR = (1 << 32) | 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _terms(words: Column) -> Column:
    def term(first: Column, second: Column | None = None) -> Column:
        both = [first] if second is None else [first, second]
        length = sum((F.char_length(w) for w in both[1:]), F.char_length(both[0]))
        return F.struct(
            F.xxhash64(*both).alias("hash"),
            F.least(length, F.lit(MAX_WEIGHT)).cast("long").alias("weight"),
        )

    pairs = F.transform(
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))),
        lambda w, i: term(words[i], w),
    )
    return F.when(F.size(words) >= 2, pairs).otherwise(F.transform(words, lambda w: term(w)))


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The ``keys``, ``high`` and ``low``: the two halves of the fingerprint of each key's text.

    Keys are unique together; NULL texts count as empty. The votes of a text are summed in the task
    that reads it, 2**32 / 31 terms of one text at least without overflow.
    """
    terms = (
        texts.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
        .select(*keys, F.explode_outer(_terms(F.col("_words"))).alias("_term"))
        .select(
            *keys,
            F.col("_term.hash").alias("_h0"),
            F.xxhash64(F.col("_term.hash"), F.lit(1)).alias("_h1"),
            F.coalesce(F.col("_term.weight"), F.lit(0)).alias("_w"),
        )
    )
    votes = [
        F.sum(F.shiftrightunsigned(f"_h{half}", i).bitwiseAND(F.lit(_PAIR)) * F.col("_w")).alias(f"_v{half}_{i}")
        for half in (0, 1)
        for i in range(32)
    ]
    counted = terms.groupBy(*keys).agg(F.sum("_w").alias("_all"), *votes)

    def bits(half: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            both = F.coalesce(F.col(f"_v{half}_{i}"), F.lit(0).cast("long"))
            for place, count in ((i, both.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(both, 32))):
                bit = 1 << place if place < 63 else -(1 << 63)
                out = out.bitwiseOR(F.when(count * 2 > F.col("_all"), F.lit(bit)).otherwise(F.lit(0).cast("long")))
        return out

    return counted.select(*keys, bits(0).alias("high"), bits(1).alias("low"))


def as_hex(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*halves: Column) -> Column:
    """1 for equal fingerprints, about 0.5 for unrelated ones."""
    return F.lit(1.0) - distance(*halves).cast("double") / BITS


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """``high``, ``low``, ``n_within``, ``nearest``: for each distinct fingerprint of ``queries`` the
    rows of ``prints`` within ``radius`` bits, itself included, and the least of their ``doc_id``.

    The 128 bits are cut into ``radius + 1`` blocks. Fingerprints within the radius agree in
    one block at least, so one table per block, keyed by the block (the permutation that
    brings it to the front), holds every match: the search is complete. A pair that meets in
    several tables counts in the first. Equal fingerprints are one entry with a count, so
    copies never meet each other.
    """
    blocks = radius + 1
    if BITS % (2 * blocks):
        raise ValueError("the radius plus one has to divide 64")
    per_half, width = blocks // 2, BITS // blocks
    mask = F.lit((1 << width) - 1)

    def block(side: str, i: int) -> Column:
        half = F.col(f"{side}high") if i < per_half else F.col(f"{side}low")
        return F.shiftrightunsigned(half, (i % per_half) * width).bitwiseAND(mask)

    def tables(df: DataFrame) -> DataFrame:
        entry = [F.struct(F.lit(i).alias("table"), block("", i).alias("block")) for i in range(blocks)]
        return df.select("*", F.explode(F.array(*entry)).alias("_e")).select("*", "_e.*").drop("_e")

    asked = tables(queries.select("high", "low").distinct()).select(
        F.col("high").alias("q_high"), F.col("low").alias("q_low"), "table", "block"
    )
    held = prints.groupBy("high", "low").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least"))
    met = asked.join(tables(held), ["table", "block"])
    first = F.coalesce(
        *[F.when(block("q_", i) == block("", i), F.lit(i)) for i in range(blocks)], F.lit(blocks)
    )
    near = distance(F.col("q_high"), F.col("q_low"), F.col("high"), F.col("low")) <= radius
    return (
        met.filter(near & (first == F.col("table")))
        .groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low"))
        .agg(F.sum("_n").alias("n_within"), F.min("_least").alias("nearest"))
    )
