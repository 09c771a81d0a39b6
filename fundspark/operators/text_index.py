"""An inverted index of character trigrams for case-insensitive substring search.

A posting holds a gram, a text's number and the places of the gram in the lower-cased text. The
places of grams that cover a term tell exactly whether it occurs, so that a search reads the
postings of a few grams, rarest first, and of the texts only those it found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 64


def _bucket(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(BUCKETS)).cast("int")


def build_text_index(df: DataFrame, key: str, text: str, path: str) -> str:
    """Index the distinct (key, text) pairs of ``df`` in a new folder, which is returned.

    It holds ``texts`` by number, partitioned by a bucket of it; ``keys``, sorted; ``postings``
    and ``grams`` with their number of texts, sorted by gram. NULL texts and texts shorter than a
    gram are found by key only.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    number = F.monotonically_increasing_id()
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct().withColumn("number", number)
    texts.withColumn("bucket", _bucket(F.col("number"))).write.partitionBy("bucket").parquet(f"{root}/texts")
    stored = spark.read.parquet(f"{root}/texts")
    keys = stored.select("key").distinct()
    keys.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{root}/keys")

    low = F.lower("text")
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    grams = F.transform(places, lambda at: F.struct(F.substring(low, at, F.lit(GRAM)).alias("gram"), at.alias("place")))
    each = stored.filter(F.length(low) >= GRAM).select("number", F.explode(grams).alias("g"))
    postings = each.groupBy(F.col("g.gram").alias("gram"), "number").agg(F.sort_array(F.collect_list("g.place")).alias("places"))
    by_gram = postings.repartitionByRange("gram", "number").sortWithinPartitions("gram", "number")
    by_gram.write.parquet(f"{root}/postings")
    counts = spark.read.parquet(f"{root}/postings").groupBy("gram").agg(F.count("*").alias("texts"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")
    return path


def cover(counts: list[int]) -> list[int]:
    """Places of grams that leave no character of a term uncovered and have the fewest postings.

    ``counts`` has the number of texts of the gram at each place of the term.
    """
    best: list[tuple[int, list[int]]] = []
    for at, n in enumerate(counts):
        before = best[max(0, at - GRAM) : at] if at else [(0, [])]
        cost, places = min(before)
        best.append((cost + n, [*places, at]))
    return best[-1][1]


def search_text_index(spark: SparkSession, path: str, term: str) -> DataFrame:
    """``key, text`` of the indexed texts that contain ``term``, whatever their case.

    The counts of the term's grams are looked up first; a gram that does not occur ends the
    search. Of the postings only those of the covering grams are read, and of the texts only the
    buckets of what was found.
    """
    if len(term) < GRAM:
        raise ValueError(f"a term has at least {GRAM} characters")
    root = path.rstrip("/")
    low = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    grams = [low[at : at + GRAM] for at in range(len(low) - GRAM + 1)]
    known = spark.read.parquet(f"{root}/grams").filter(F.col("gram").isin(grams)).collect()
    counts = {r.gram: r.texts for r in known}
    texts = spark.read.parquet(f"{root}/texts")
    if any(g not in counts for g in grams):
        return texts.limit(0).select("key", "text")
    postings = spark.read.parquet(f"{root}/postings")

    def starts(at: int) -> DataFrame:
        """Where the term would have to start, for each text with the gram at this place of it."""
        moved = F.transform("places", lambda p: p - at)
        return postings.filter(F.col("gram") == grams[at]).select("number", moved.alias(f"starts_{at}"))

    def both(found: DataFrame, at: int) -> DataFrame:
        common = F.array_intersect("starts", f"starts_{at}")
        return found.join(starts(at), "number").select("number", common.alias("starts")).filter(F.size("starts") > 0)

    rarest, *others = sorted(cover([counts[g] for g in grams]), key=lambda at: counts[grams[at]])
    first = starts(rarest).withColumnRenamed(f"starts_{rarest}", "starts")
    found = reduce(both, others, first).select("number", _bucket(F.col("number")).alias("bucket"))
    return found.join(texts, ["number", "bucket"]).select("key", "text")
