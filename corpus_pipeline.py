"""A corpus pipeline: quality rules, exact dedup, near dedup, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All stages but the last return the columns of documents. Rows that are null or empty go with the
quality rules; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import exact_dedup, host_quality, jaccard_join, packing, pii
from tracelode.llm.common import content_key
from tracelode.llm.queries import WORD_VOCABULARY, documents, vocabulary
from tracelode.session import tune, work_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows whose id and text a verdict (doc_id, content_key, kept) keeps; the hash tells texts of one id apart."""
    keys = verdict.where("kept").select(F.col("doc_id").alias("kept_id"), "content_key")
    rows = docs.withColumn("content_key", content_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (rows["content_key"] == keys["content_key"])
    return rows.join(keys, same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and come from no condemned host."""
    tune(spark)
    return _kept(docs, host_quality.judge(docs)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id; of rows equal in id too, one."""
    return _kept(docs, exact_dedup.duplicates(docs)).dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near equality, the one with the smallest id."""
    return _kept(docs, jaccard_join.groups(docs)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced by its kind."""
    model = pii.learn(pii.search(docs))
    text = F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), model))
    return docs.select("doc_id", text.alias("text"), "lang", "source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("pii", personal_data),
    ("best_fit_packing", packed),
]
#: The classifier of personal data and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
