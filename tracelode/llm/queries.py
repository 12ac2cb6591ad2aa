"""The registered queries: each applies its operator to the whole table and keeps the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import (
    byte_bpe, decontaminate, exact_dedup, hard_negatives, host_quality, jaccard_join, language_id, license_scan, packing, pii,
    spelling, substring_dedup, toxicity,
)
from tracelode.session import tune

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules of every document, with verdicts on hosts."""
    return host_quality.judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_condemned",
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    return substring_dedup.dedup(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.classify(documents(spark, folder), labels).select("doc_id", "held_out", "score", "predicted")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(documents(spark, folder)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(documents(spark, folder))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 5-word shingles overlap by 0.8 or more."""
    return jaccard_join.groups(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' tokens packed into sequences."""
    return packing.pack(documents(spark, folder), vocabulary(WORD_VOCABULARY))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(documents(spark, folder))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal documents and the one that stays."""
    return exact_dedup.duplicates(documents(spark, folder)).drop("content_key")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to byte-level BPE ids and decoded again."""
    import public_tokenizers

    done = byte_bpe.round_trip(documents(spark, folder), vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark, and the items they are from."""
    found = decontaminate.scan(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(tune(spark).read.parquet(f"{folder}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and its root."""
    return spelling.variants(documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


ALL = (
    op1_host_quality, op2_substring_dedup, op3_toxicity, op4_license_scan, op5_language_id, op6_ngram_jaccard,
    op7_best_fit_packing, op8_personal_data, op9_exact_dedup, op10_byte_bpe, op11_decontaminate,
    op12_hard_negatives, op13_spelling_variants, pipeline,
)


def registered() -> dict:
    return {query.__name__: query for query in ALL}
