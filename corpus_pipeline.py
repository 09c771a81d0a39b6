"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes the documents that the stage before has kept, from Parquet, and returns the
columns of documents; the last one returns the pieces of sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.llm import mixing, neardup, packing, repeats
from fundspark.llm.common import documents, stage
from fundspark.llm.queries_text import identifier, tokenizer_path

#: Each marginal is moved towards an even one by this power; so much of all tokens is sampled.
MIX = {"source": 0.8, "lang": 0.8, "_topic": 0.8}
BUDGET_SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out what the language models reject: texts in no known language, without letters or NULL."""
    predicted = identifier(docs).predict(docs, keep_text=True)
    return predicted.filter(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each class; rows without doc_id stay."""
    classes = neardup.similarity_classes(docs)
    chosen = classes.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    first = docs.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what an earlier document has; documents of which nothing is left go."""
    cleaned = repeats.remove_repeats(docs, as_text=True).filter(F.char_length("kept") > 0)
    return cleaned.withColumns(
        {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    ).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample the documents by weights raked to source, language and topic."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+")).cast("bigint")
    measured = docs.select("doc_id", "source", "lang", mixing.marker_topic(F.col("text")).alias("_topic"), words.alias("tokens"))
    mixed = mixing.mix(stage(measured, "measured"), MIX, budget_share=BUDGET_SHARE)
    # A document's fate follows from its doc_id and cell, so it is joined back by these.
    kept = mixed.filter("kept").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "lang")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "lang")]
    return docs.join(kept, same, "left_semi").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of at most 2048 tokens."""
    tokens = packing.tokenised(docs, tokenizer_path(), narrow=True)
    return packing.widened(packing.pack(tokens)).select(
        "doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "certified"
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packed),
]

#: SQL has no means for language models, MinHash, suffixes or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
