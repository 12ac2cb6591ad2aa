"""Removal of passages that an earlier document has already.

A window is a fixed number of consecutive words. Documents are dealt to chunks of consecutive ids. Each chunk
hashes all its windows (Rabin-Karp), sends the distinct hashes to the owners of hash ranges, and learns for each
whether a chunk of smaller ids has it. With what it sees itself, a chunk then knows every window that a smaller
id has; overlapping windows merge into maximal intervals, which are cut out. Texts are shuffled once.

A hash has 64 bits and a check of 16 more, so wrong matches are to be expected only beyond some 10^12 windows.

Defined cases: null text has no words; a null id comes after all ids and never counts as the smaller one; rows
with equal ids don't remove from each other; texts shorter than a window keep all words; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import exchange, rolling
from tracelode.llm.common import Size, measure, pieces

WINDOW = 13
#: Text bytes of a chunk and hashes of an owner's range, about; both bound a task's memory.
CHUNK_BYTES = 8 << 20
RANGE_SIZE = 1_000_000
#: Sampled ids for each bound between chunks; bounds decide only how evenly work is dealt.
SAMPLES_PER_CHUNK = 30
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>"


def bounds(docs: DataFrame, size: Size, chunks: int) -> np.ndarray:
    """Ids that cut the table into chunks of about equal text."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    wanted = max(10_000, SAMPLES_PER_CHUNK * chunks)
    sample = rows.sample(min(1.0, wanted / max(1, size.rows)), 7).toArrow().sort_by("doc_id")
    ids, weight = sample["doc_id"].to_numpy(), sample["n"].to_numpy().astype(np.float64) + 1
    if not len(ids):
        return np.zeros(0, np.int64)
    share = np.cumsum(weight) / weight.sum()
    return np.unique(ids[np.minimum(np.searchsorted(share, np.arange(1, chunks) / chunks), len(ids) - 1)])


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, Size]:
    """doc_id, text and chunk. Chunks at or past the returned count hold the rows without id."""
    size = measure(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = bounds(docs, size, pieces(size.text_bytes, chunk_bytes))
    count = len(cuts) + 1

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64), side="right"))

    spread = count + F.pmod(F.xxhash64("text"), F.lit(count))
    return docs.withColumn("chunk", F.when(F.col("doc_id").isNull(), spread).otherwise(place("doc_id"))), count, size


class Windows:
    """The windows of a chunk's texts, in order of id; `values` are the distinct hashes."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("doc_id", "ascending")])
        self.ids = table["doc_id"]
        self.index, self.counts, self.vocabulary = rolling.index_words((x.as_py() for x in table["text"]))
        self.starts, self.text = rolling.inside(self.counts, width)
        first, second = rolling.digests(self.vocabulary)
        hashes = rolling.roll(first[self.index], width)[self.starts]
        self.values, self.at, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.second = second[self.index]
        self.width = width

    def check(self) -> np.ndarray:
        lane = rolling.roll(self.second, self.width, 1)[self.starts]
        return (lane[self.at] >> np.uint64(48)).astype(np.uint16)


def sent(table: pa.Table, width: int, bits: int) -> pa.Table:
    found = Windows(table, width)
    return exchange.messages(table["chunk"][0].as_py(), found.values, bits, found.check())


def earlier(values: np.ndarray, chunk: np.ndarray, rest: list[bytes], with_ids: int) -> np.ndarray:
    """Whether a smaller chunk has sent the same hash and check."""
    check = np.frombuffer(b"".join(rest), np.uint16)
    order = np.lexsort((check, values))
    v, c = values[order], check[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
    out = np.zeros(len(v), bool)
    out[order] = ~first & (chunk[order][head] < with_ids)
    return out


def cut_out(table: pa.Table, answers: pa.Table, width: int, bits: int) -> pa.Table:
    found = Windows(table, width)
    ids = np.array([np.iinfo(np.int64).max if x is None else x for x in found.ids.to_pylist()], np.int64)
    before = exchange.unpack(exchange.replies(answers), found.values, bits, exchange.read_bits).astype(bool)
    own = ids[found.text]
    gone = before[found.inverse] | (own > own[found.at][found.inverse]) if len(own) else np.zeros(0, bool)
    steps = np.zeros(len(found.index) + 1, np.int32)
    hit = found.starts[gone]
    steps[hit] += 1
    steps[hit + width] -= 1
    covered = np.cumsum(steps[:-1]) > 0
    ends = np.cumsum(found.counts)
    word, n_removed, kept, spans = found.vocabulary.__getitem__, [], [], []
    for begin, end in zip(ends - found.counts, ends, strict=True):
        part = covered[begin:end]
        n = int(part.sum())
        n_removed.append(n)
        kept.append(b" ".join(map(word, found.index[begin:end][~part].tolist())).decode())
        if n:
            edges = np.flatnonzero(np.diff(part, prepend=False, append=False)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        else:
            spans.append([])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "doc_id": found.ids, "n_words": pa.array(found.counts), "n_removed": pa.array(n_removed, pa.int64()),
        "kept_text": pa.array(kept, pa.string()), "removed": pa.array(spans, span),
    })


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, and the removed word intervals."""
    rows, with_ids, size = chunked(docs)
    bits = exchange.shard_bits(size.text_bytes // 6, RANGE_SIZE)
    messages = rows.groupBy("chunk").applyInArrow(lambda t: sent(t, width, bits), exchange.MESSAGE)
    answers = exchange.own(messages, lambda v, c, r: earlier(v, c, r, with_ids), exchange.bitmap)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: cut_out(left, right, width, bits), RESULT)
