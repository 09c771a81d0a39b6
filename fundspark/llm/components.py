"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("m")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, F.col("a") == F.col("m")).filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("least"))
    joined = edges.join(least, F.col("a") == F.col("m"))
    down = joined.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.unionByName(least.select(F.col("m").alias("a"), F.col("least").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (a, b); the root is the component's least node.

    Each round shuffles the edges a few times and writes them once; their number never
    grows. Rounds follow the logarithm of the largest component. Loops and repeated edges are
    allowed.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stage(edges.select(high.alias("a"), low.alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stage(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
