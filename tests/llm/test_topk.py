"""Exact top-k search against all inner products."""

import math
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fundspark.llm import queries_text as queries
from fundspark.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, row int, score string"


def brute(rows, is_query, k):
    kept = [
        (key, [math.floor(256 * x) for x in v]) for key, v in rows
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, (key, v) in enumerate(kept):
        if is_query(key):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), other) for j, (other, w) in enumerate(kept) if i != j)
            out += [(key, rank + 1, other, -s) for rank, (s, other) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, k=5, every=50, **sizes):
    table = spark.createDataFrame([(key, v, 7, "x") for key, v in rows], SCHEMA).repartition(4)
    found = topk.top_k(topk.vectors(table), F.col("vec_id") % every == 0, k, **sizes)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("lists, width", [(4, 16), (1, 5), (3, 2)])
def test_equals_all_products(spark, lists, width):
    draw = random.Random(lists)
    rows = [(i, [draw.gauss(0, 0.1) for _ in range(width)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000 + i, [-x for x in rows[50][1]]) for i in range(30)]
    found = search(spark, rows, lists=lists, row_block=90, query_block=4)
    assert found == brute(rows, lambda k: k % 50 == 0, 5)


def test_odd_vectors_repeats_and_few_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (100, []), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]),
        (4, [math.inf, 0.0]), (None, [1.0, 1.0]), (5, [-0.001, 0.1, 9.0]), (150, [1e6, -1e6]), (6, [4e7, 1.0]), (7, [3e7, 3e7]),
    ]
    assert search(spark, rows, k=9) == brute(rows, lambda k: k % 50 == 0, 9)
    assert search(spark, rows, k=2, row_block=3, query_block=1) == brute(rows, lambda k: k % 50 == 0, 2)
    assert search(spark, rows[:1]) == [] and search(spark, []) == [] and search(spark, [(1, [1.0])]) == []


def test_scores_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="Overflow|too large"):
        search(spark, [(0, [1e12]), (1, [1e12])])


def test_pruning_keeps_what_reaches_the_cutoff():
    """Most entries stay below the uniform threshold once the cutoff is known."""
    import numpy as np

    draw = np.random.default_rng(1)
    queries_, rows = draw.integers(-100, 100, (20, 64)), draw.integers(-100, 100, (5000, 64))
    rows[:200] = np.repeat(queries_, 10, axis=0) + draw.integers(-20, 20, (200, 64))
    parts = topk._lists(queries_, rows, 4)
    totals = parts.sum(axis=0)
    assert (totals == queries_ @ rows.T).all()
    cut = np.sort(totals, axis=1)[:, -5][:, None]
    seen = (parts >= cut / 4).any(axis=0)
    assert (seen | (totals < cut)).all() and seen.mean() < 0.05


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    result = queries.op13_topk(spark, SMALL)
    assert result.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in result.collect()) == brute(rows, lambda k: k % 50 == 0, 5)
