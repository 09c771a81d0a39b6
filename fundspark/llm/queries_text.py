"""Queries of the operators that work on Arrow batches of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.llm import alignment, langid, licenses, neardup, packing, repeats, spelling, topk
from fundspark.llm.common import documents

QUERY_EVERY, BEST = 50, 5
FOLDS = 5
CALIBRATION_FOLD = 1


def fold(key: Column) -> Column:
    """CRC-32 of the key's text modulo five; a NULL key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def identifier(docs: DataFrame) -> langid.Identifier:
    """Fitted outside fold 0: calibrated on fold 1, counted on the others."""
    folded = docs.select("lang", "text", fold(F.col("doc_id")).alias("_fold"))
    return langid.fit(
        folded.filter(F.col("_fold") > CALIBRATION_FOLD), folded.filter(F.col("_fold") == CALIBRATION_FOLD)
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by character models of the other folds."""
    docs = documents(spark, sf_dir)
    return identifier(docs).predict(docs.select("doc_id", "text")).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy"
    )


TOKENIZER, SECOND_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    tokens = packing.tokenised(documents(spark, sf_dir), tokenizer_path(), narrow=True)
    return packing.widened(packing.pack(tokens)).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "certified"
    )


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document at a similarity of 0.8."""
    return neardup.similarity_classes(documents(spark, sf_dir))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat an earlier one."""
    cleaned = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in all documents."""
    notices = spark.createDataFrame(licenses.NOTICES, "license string, text string")
    return licenses.scan(documents(spark, sf_dir), notices)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie on every document."""
    return alignment.align(documents(spark, sf_dir), tokenizer_path(), tokenizer_path(SECOND_TOKENIZER))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling.variants(documents(spark, sf_dir))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows by inner product for every fiftieth vector."""
    rows = topk.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(rows, F.col("vec_id") % QUERY_EVERY == 0, BEST)


QUERIES = {
    "op3_language": op3_language,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_suffix_array": op6_suffix_array,
    "op7_packing": op7_packing,
    "op10_license_scan": op10_license_scan,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_topk": op13_topk,
}
ORACLE: dict[str, str] = {}
