"""The corpus pipeline on a small table, stage by stage and as a whole."""

import corpus_pipeline as pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fundspark.llm.common import stage

from .conftest import DOCS, ODD, words
from .test_text import brute_classes, brute_removed


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, step in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(step(spark, docs, SMALL), name)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and 0 < len(kept) <= len(rows)
        if name == "near_duplicates":
            assert sorted(kept) == sorted({c for _, c, _ in brute_classes(rows)})
        if name == "repeated_passages":
            left = {k: rest.decode("utf-8", "ignore") for k, *_, rest in brute_removed(rows)}
            assert {k: r.text for k, r in kept.items()} == {k: t for k, t in left.items() if t}
            assert all(r.n_chars == len(r.text) for r in kept.values())
    whole = pipeline.run(spark, SMALL)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == set(kept)


@pytest.mark.parametrize("name, step", pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, make, name, step):
    rows = ODD + [(40 + i, words(i, 60), ("en", None)[i % 2], ("a", None)[i % 3 == 0], None) for i in range(12)]
    docs = make(rows).withColumn("weight", F.lit(1)).withColumn("tokens", F.lit("x"))
    out = step(spark, docs, SMALL)
    assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
    assert step(spark, make([], DOCS), SMALL).count() == 0
