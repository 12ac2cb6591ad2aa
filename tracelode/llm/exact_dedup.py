"""Exact duplicates by a Golomb-coded exchange of fingerprints, verified on the bytes.

Every document gets a fingerprint of its normalised text. Chunks of rows send their sorted fingerprints,
Rice-coded, to the owners of fingerprint ranges and get back a bitmap of those that other chunks have too.
Only rows under suspicion are read again with their text; equal texts are grouped on the text itself.

Defined cases: null text counts as empty; a null id sorts after every id, and where no copy has an id one row
of them stays; of rows equal in id and text one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm import exchange
from tracelode.llm.common import SPACE_RUN, content_key, measure, pieces, row_key, whole
from tracelode.session import cut

#: Rows of a chunk, and fingerprints of an owner's range, about; both bound a task's memory.
CHUNK_ROWS = 50_000
RANGE_SIZE = 50_000


def normalised(text: str = "text") -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(whole(text), SPACE_RUN, " ")


def sent(table: pa.Table, bits: int) -> pa.Table:
    prints = np.unique(table["fp"].to_numpy().view(np.uint64))
    return exchange.messages(table["chunk"][0].as_py(), prints, bits)


def elsewhere(values: np.ndarray, chunk: np.ndarray, rest: list[bytes]) -> np.ndarray:
    """Whether another chunk has sent the same fingerprint."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def flagged(table: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """The chunk's rows, under suspicion where the chunk itself or another has the fingerprint again."""
    prints, inverse, count = np.unique(table["fp"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    other = exchange.unpack(exchange.replies(answers), prints, bits, exchange.read_bits).astype(bool)
    return table.select(["doc_id", "row_key", "content_key", "sha"]).append_column("suspect", pa.array(((count > 1) | other)[inverse]))


def suspects(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, sha and suspect of every row; stored, so that later steps need no text for the rest."""
    size = measure(docs)
    chunks, bits = pieces(size.rows, CHUNK_ROWS, 8), exchange.shard_bits(size.rows, RANGE_SIZE)
    prints = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), content_key().alias("content_key"),
        F.unhex(F.sha2(normalised(), 256)).alias("sha"),
    )).withColumn("fp", F.xxhash64("sha")).withColumn("chunk", F.pmod(F.xxhash64("row_key"), F.lit(chunks)))
    messages = prints.select("chunk", "fp").groupBy("chunk").applyInArrow(lambda t: sent(t, bits), exchange.MESSAGE)
    answers = exchange.own(messages, elsewhere, exchange.bitmap)
    schema = "doc_id long, row_key long, content_key long, sha binary, suspect boolean"
    return cut(prints.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: flagged(left, right, bits) if left.num_rows else pa.table({
            "doc_id": pa.array([], pa.int64()), "row_key": pa.array([], pa.int64()), "content_key": pa.array([], pa.int64()), "sha": pa.array([], pa.binary()),
            "suspect": pa.array([], pa.bool_()),
        }), schema))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the hash of its normalised text."""
    marked = suspects(docs)
    alone = marked.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "content_key",
    )
    # By id and text: an id may stand for several texts, of which only some are under suspicion.
    keys = marked.where("suspect").select("content_key").distinct()
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("content_key"), "text").join(
        keys, "content_key", "left_semi").select("doc_id", "content_key", normalised().alias("body"))
    # Copies collapse before the shuffle, so a group that holds a third of all rows is sent once per task.
    groups = again.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = again.join(groups, "body").select(
        "doc_id", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"), "content_key",
    )
    same = Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id")
    copies = joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"), "text_sha256", "content_key",
    )
    return alone.unionByName(copies)
