"""Toxicity by class-conditional Kneser-Ney models.

Bigram models of toxic and of ordinary text are counted over all labelled documents that may be learned from, with
every word and every bigram they have; a document counts each of its bigrams once. Both back off, by way of the
words of their class, to the same continuation counts, pooled over the classes. How far a word or bigram may part
the classes is weighed by its own evidence: the odds that its counts differ by more than chance, from their
likelihood ratio, against fixed prior odds. So a rare expression gets its small share and not nothing, and the many
rare words that chance has put into one class do not add up. Where a bigram has no evidence of its own, both classes
back off with the same weight.

Counts and log-ratios are tables that grow with the corpus. A text's distinct bigrams are joined with them and
summed; the sum, normalised by length, is turned to a probability by a logistic curve, fitted on labelled documents
that the counts behind it have not seen. Only that curve is of bounded size. The join goes by blocks: a chunk of texts
sends each range of keys one row, with its distinct keys there and the texts that have them; the range looks them up
among its log-ratios and answers with a sum for each text.

Every bigram and every text takes part, but not all at once: counts are made and weighed by parts of the bigrams, texts
are scored by parts of the rows. What a part shuffles is freed when it ends, and tables are dropped when nothing more
needs them, so that the disk holds a part and not the whole. The log-ratios lie in buckets of their range, for all parts.

Words are taken as equal by 64 bits of hash.

Defined cases: null and empty texts have no words and get the score of no evidence; a table without labels, or
with one class only, gives everything the share of toxic labels; each row is scored by itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.byte_bpe import slices
from tracelode.llm.common import content_key, measure, pieces, row_key
from tracelode.llm.exchange import ranges
from tracelode.session import freeing, work_path

#: Prior odds, as a logarithm, against a word or bigram that tells the classes apart: about one in a thousand does.
#: Of 3, 5, 7 and 9 it has the least log loss on training rows with remainder 3, by counts of the other training rows.
PRIOR = 7.0
DISCOUNT = 0.75
#: The calibration curve is fitted on at most about this many labelled documents.
CALIBRATION_ROWS = 100_000
LIMIT = 0.3
#: Texts of about so many bytes make a part, until there are this many parts of rows and of bigrams (a power of two).
PART_BYTES, ROW_PARTS, GRAM_PARTS = 8 << 20, 8, 8
#: Words in a bucket, and log-ratios in a range of keys, about; a task holds one at a time.
BUCKET_ROWS, RANGE_ROWS = 500_000, 300_000
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4 << 20
#: What stands before a text's first word, and where a word counts by itself.
FIRST, ALONE = 1, 0
#: Bits by which the word before is turned in a bigram's key.
TURN = 23
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
CLEAN = bytes.maketrans(bytes(range(65, 91)) + SIGNS, bytes(range(97, 123)) + b" " * len(SIGNS))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 marks what is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def first(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text and index (from 1) of each word in order, and the distinct words."""
    clean = pa.array([(t or b"").translate(CLEAN) for t in texts], pa.large_binary())
    lists = pc.ascii_split_whitespace(pc.cast(clean, options=pc.CastOptions(pa.large_string(), allow_invalid_utf8=True)))
    found, text = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    # Signs at either end of a text leave an empty word there.
    some = pc.not_equal(pc.binary_length(found), 0)
    coded = found.filter(some).dictionary_encode()
    return text[some.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64) + 1, coded.dictionary.cast(pa.large_binary()).to_pylist()


@dataclass
class Grams:
    """Distinct bigrams of each text, as word, word before and text in order, and its words, with n bigrams that end in them."""

    hashes: np.ndarray
    word: np.ndarray
    before: np.ndarray
    text: np.ndarray
    single: np.ndarray
    single_text: np.ndarray
    n: np.ndarray


def grams(texts: list[bytes | None]) -> Grams:
    text, index, distinct = words_of(texts)
    digests = b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in distinct])
    hashes = np.concatenate([np.array([FIRST], np.int64), np.frombuffer(digests, "<i8")])
    size, rows = len(hashes), max(1, len(texts))
    before = np.zeros_like(index)
    before[1:] = np.where(text[1:] == text[:-1], index[:-1], 0)
    triples = np.sort((index * size + before) * rows + text)
    triples = triples[first(triples)]
    pair, text = np.divmod(triples, rows)
    word, before = np.divmod(pair, size)
    ends = np.sort(word * rows + text)
    starts = np.flatnonzero(first(ends))
    return Grams(hashes, word, before, text, *np.divmod(ends[starts], rows), np.diff(np.append(starts, len(ends))))


@dataclass
class Table:
    """A table of the warehouse that is dropped when nothing more needs it."""

    spark: SparkSession
    name: str

    def add(self, df: DataFrame, part: str | None = None, key: str | None = None, buckets: int = 0) -> Table:
        """Write rows, in folders by `part` or, if they are dealt so, in buckets by `key`; what they shuffle is freed."""
        with freeing(self.spark):
            writer = df.write.mode("append").format("parquet").option("compression", "zstd")
            writer = writer.partitionBy(part) if part else writer
            (writer.bucketBy(buckets, key) if key else writer).saveAsTable(self.name)
        return self

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, part: int | None = None) -> None:
        """Drop the table, or one part's folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}" if part is None else f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = {part})")


def new_table(spark: SparkSession) -> Table:
    return Table(spark, f"toxicity_{uuid.uuid4().hex}")


def buckets_of(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows; fewer than the shuffle's partitions would not be joined as they lie."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(rows, BUCKET_ROWS))


def gram_counts(batches: Iterable[pa.RecordBatch], parts: int = 1, wanted: range = range(1)) -> Iterator[pa.RecordBatch]:
    """Documents of each group (toxic + 2 * late) that have a bigram or, with ALONE before it, a word; of the wanted parts."""

    def rows(before: np.ndarray, word: np.ndarray, new: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        here = ((before & (parts - 1)) >= wanted.start) & ((before & (parts - 1)) < wanted.stop)
        n = np.bincount((np.cumsum(new) - 1) * 4 + of, minlength=4 * len(word)).reshape(-1, 4)[here]
        return pa.RecordBatch.from_arrays([pa.array(before[here]), pa.array(word[here]), *[pa.array(n[:, g]) for g in range(4)]], ["before", "word", "c0", "c1", "c2", "c3"])

    for batch in batches:
        group, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary()).to_pylist()
        for a, b in slices([len(t or b"") for t in texts], CHUNK_BYTES):
            found, of = grams(texts[a:b]), group[a:b]
            new = first(found.word * len(found.hashes) + found.before)
            yield rows(found.hashes[found.before[new]], found.hashes[found.word[new]], new, of[found.text])
            new = first(found.single)
            yield rows(np.full(new.sum(), ALONE), found.hashes[found.single[new]], new, of[found.single_text])


def counted(train: DataFrame, parts: int) -> list[Table]:
    """before, word, and the early and all documents of either class that have them: e0, e1, a0, a1; in tables by part."""
    c, tables = [F.sum(f"c{g}") for g in range(4)], []
    half = max(1, parts // 2)
    for start in range(0, parts, half):
        wanted = range(start, start + half)
        rows = train.select((F.col("toxic") + 2 * F.col("late")).cast("int").alias("g"), "text").mapInArrow(
            lambda batches, wanted=wanted: gram_counts(batches, parts, wanted), "before long, word long, c0 long, c1 long, c2 long, c3 long")
        found = rows.groupBy("before", "word").agg(
            c[0].alias("e0"), c[1].alias("e1"), (c[0] + c[2]).alias("a0"), (c[1] + c[3]).alias("a1")).withColumn(
            "part", F.col("before").bitwiseAND(parts - 1))
        # In order, the word before takes next to no room.
        tables.append(new_table(train.sparkSession).add(found.sortWithinPartitions("part", "before", "word"), part="part"))
    return tables


def surprise(n: Column, expected: Column) -> Column:
    """n log(n / expected), a summand of the likelihood ratio."""
    return F.when((n > 0) & (expected > 0), n * F.log(n / expected)).otherwise(0.0)


def weight(ratio: Column) -> Column:
    """The probability that counts of this likelihood ratio differ by more than chance."""
    return 1 / (1 + F.exp(PRIOR - F.least(ratio, F.lit(100.0))))


@dataclass
class Ratios:
    """A table of log-ratios by ranges of their key's first bits: range, keys and, for each kind of counts, their log-ratios."""

    table: Table
    bits: int
    buckets: int

    def add(self, df: DataFrame, kinds: Iterable[str]) -> None:
        """Add rows of key and kinds, a block for each range."""
        names = ["keys", *kinds]

        def block(rows: pa.Table) -> pa.Table:
            return pa.table([rows["range"][:1], *[pa.array([rows[n].to_numpy().tobytes()], pa.binary()) for n in names]], ["range", *names])

        rows = df.select(F.shiftrightunsigned("key", 64 - self.bits).cast("int").alias("range"), F.col("key").alias("keys"), *kinds)
        blocks = rows.repartition(self.buckets, "range").groupBy("range").applyInArrow(block, "range int, " + ", ".join(f"{n} binary" for n in names))
        self.table.add(blocks, key="range", buckets=self.buckets)


def log_ratios(tables: list[Table], parts: int, kinds: dict[str, tuple[float, float]]) -> Ratios:
    """By key, for each kind of counts (e, a), what a word or a bigram besides its word adds to a text's log-ratio.

    kinds has the documents of either class. The tables of counts are dropped as they are used up.
    """
    spark, counts = tables[0].spark, tables[0].rows
    for table in tables[1:]:
        counts = counts.unionByName(table.rows)
    pair = F.col("before") != ALONE
    one = lambda c: F.when(pair, F.col(c))
    names = [f"{k}{c}" for k in kinds for c in (0, 1)]
    size = counts.count()
    buckets = buckets_of(spark, size)
    kept = new_table(spark).add(counts.groupBy("word").agg(
        *[F.sum(F.when(~pair, F.col(n))).alias(f"d{n}") for n in names], *[F.sum(one(n)).alias(f"w{n}") for n in names],
        *[F.count(F.when(pair & (F.col(f"{k}0") + F.col(f"{k}1") > 0), 1)).alias(f"t{k}") for k in kinds]).repartition(buckets, "word"), key="word", buckets=buckets)
    words = kept.rows
    sums = words.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"w{n}").alias(f"w{n}") for n in names], *[F.count(F.when(F.col(f"w{n}") > 0, 1)).alias(f"k{n}") for n in names],
        *[F.sum(f"t{k}").alias(f"t{k}") for k in kinds]).first()
    made, bigram = [], []
    for k, documents in kinds.items():
        total = sum(documents)
        rate = [n / total for n in documents]
        shared = (F.col(f"t{k}") + 0.5) / F.lit(float((sums[f"t{k}"] or 0) + 0.5 * (sums["v"] + 1)))
        p = []
        for c in (0, 1):
            of = float(max(1, sums[f"w{k}{c}"] or 0))
            p.append(F.greatest(F.col(f"w{k}{c}") - DISCOUNT, F.lit(0.0)) / of + DISCOUNT * max(1, sums[f"k{k}{c}"]) / of * shared)
        d = [F.col(f"d{k}{c}") for c in (0, 1)]
        both = d[0] + d[1]
        evidence = sum((surprise(d[c], both * rate[c]) + surprise(documents[c] - d[c], (total - both) * rate[c]) for c in (0, 1)), F.lit(0.0))
        made += [p[0].alias(f"p{k}"), (weight(evidence) * F.log(p[1] / p[0])).alias(f"r{k}")]
        # The bigram's class probabilities over those of its word, where the bigram's own counts are evidence.
        lower = [F.col(f"p{k}"), F.col(f"p{k}") * F.exp(f"r{k}")]
        q = []
        for c in (0, 1):
            n, of = F.col(f"{k}{c}"), F.col(f"n{k}{c}")
            q.append(F.when(of > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / of + DISCOUNT * F.col(f"k{k}{c}") / of * lower[c]).otherwise(lower[c]))
        odds = F.exp(f"r{k}") * (rate[1] / max(rate[0], 1e-9))
        n = F.col(f"{k}0") + F.col(f"{k}1")
        own = surprise(F.col(f"{k}0"), n / (1 + odds)) + surprise(F.col(f"{k}1"), n * odds / (1 + odds))
        bigram.append(F.when(n > 0, weight(own) * (F.log(q[1] / q[0]) - F.col(f"r{k}"))).otherwise(0.0).cast("float").alias(k))
    words = words.select("word", *made)
    ranged = max(3, (pieces(size, RANGE_ROWS) - 1).bit_length())
    ratios = Ratios(new_table(spark), ranged, max(1 << ranged, buckets))
    ratios.add(words.select(F.col("word").alias("key"), *[F.col(f"r{k}").cast("float").alias(k) for k in kinds]), kinds)
    for i, table in enumerate(tables):
        each = parts // len(tables)
        for part in range(i * each, (i + 1) * each):
            found = table.rows.where(pair & (F.col("part") == part)).drop("part")
            # All bigrams after a word are of one part.
            contexts = found.groupBy("before").agg(
                *[F.sum(n).alias(f"n{n}") for n in names], *[F.count(F.when(F.col(n) > 0, 1)).alias(f"k{n}") for n in names])
            ratios.add(found.join(words.hint("shuffle_hash"), "word").join(contexts.hint("merge"), "before").select(key_of(), *bigram), kinds)
            table.drop(part)
        table.drop()
    kept.drop()
    return ratios


def key_of() -> Column:
    """A bigram's key: its word's hash, changed by the hash of the word before; a word by itself has its hash as key."""
    before = F.col("before")
    return F.col("word").bitwiseXOR(F.shiftleft(before, TURN).bitwiseOR(F.shiftrightunsigned(before, 64 - TURN))).alias("key")


def turned(before: np.ndarray) -> np.ndarray:
    before = before.view(np.uint64)
    return (before << np.uint64(TURN)) | (before >> np.uint64(64 - TURN))


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0, in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    """The n numbers of `narrow`."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def read(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


#: What a chunk sends a range of keys: its distinct keys there, how many texts have each, which (by their place in ids)
#: and, for each of them, how often it counts. One more row for each chunk has all ids, the bigrams of each and its rows.
SENT = "range int, chunk long, keys binary, texts binary, at binary, times binary, ids binary, size binary, copies binary"
ANSWER = "chunk long, ids binary, total binary, size binary, copies binary"
SUMS = "id long, total double, n long, copies long"


def sent(chunk: int, ids: np.ndarray, found: Grams, bits: int) -> pa.RecordBatch:
    ids, own = np.unique(ids, return_inverse=True)
    pair, single = np.flatnonzero(first(found.word * len(found.hashes) + found.before)), np.flatnonzero(first(found.single))
    hashes = found.hashes.view(np.uint64)
    keys = np.concatenate([hashes[found.word[pair]] ^ turned(found.hashes[found.before[pair]]), hashes[found.single[single]]])
    texts = np.diff(np.concatenate([pair, len(found.text) + single, [len(found.text) + len(found.n)]]))
    at, times = own[np.concatenate([found.text, found.single_text])], np.concatenate([np.ones(len(found.text), np.int64), found.n])
    # In order of their key, each with its texts.
    order = np.argsort(keys)
    begin, keys, texts = (np.cumsum(texts) - texts)[order], keys[order], texts[order]
    ends = np.append(0, np.cumsum(texts))
    moved = np.repeat(begin - ends[:-1], texts) + np.arange(ends[-1])
    at, times = at[moved], times[moved]
    rows = []
    if len(keys):
        owner, cuts = ranges(keys, bits)
        for o, a, b in zip(owner.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            met, place = np.unique(at[ends[a]:ends[b]], return_inverse=True)
            rows.append((o, chunk, keys[a:b].tobytes(), narrow(texts[a:b]), narrow(place), narrow(times[ends[a]:ends[b]]), ids[met].tobytes(), b"", b""))
    size = np.bincount(own[found.text], minlength=len(ids))
    rows.append((chunk & ((1 << bits) - 1), chunk, b"", b"", b"", b"", ids.tobytes(), size.tobytes(), np.bincount(own, minlength=len(ids)).tobytes()))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SENT.split(", ")])


def answered(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """For each row sent to a range, the sum over its keys for each of its texts; keys without a log-ratio add nothing."""
    known = np.concatenate([np.zeros(0, np.uint64), *read(blocks["keys"], "u8")])
    order = np.argsort(known)
    # One more, which no key finds.
    known, ratio = known[order], np.append(np.concatenate([np.zeros(0, "f4"), *read(blocks["ratio"], "f4")])[order], np.float32(0)).astype(float)
    totals = []
    for keys, texts, at, times, ids in zip(*(asked[c].to_pylist() for c in ("keys", "texts", "at", "times", "ids")), strict=True):
        keys = np.frombuffer(keys, "u8")
        place = np.searchsorted(known, keys)
        place[np.append(known, np.uint64(0))[place] != keys] = len(known)
        value = np.repeat(ratio[place], widen(texts, len(keys)))
        totals.append(np.bincount(widen(at, len(value)), value * widen(times, len(value)), minlength=len(ids) // 8).tobytes())
    return pa.table([asked["chunk"], asked["ids"], pa.array(totals, pa.binary()), asked["size"], asked["copies"]], [c.split()[0] for c in ANSWER.split(", ")])


def gathered(answers: pa.Table) -> pa.Table:
    """The sums of a chunk's texts over all ranges."""
    ids, place = np.unique(np.concatenate(read(answers["ids"], "i8")), return_inverse=True)
    # The row of all ids alone has sizes and copies.
    total = np.bincount(place, np.concatenate(read(answers["total"], "f8")), minlength=len(ids))
    size, copies = (np.zeros(len(ids), np.int64) for _ in range(2))
    for own, n, rows in zip(*(read(answers[c], "i8") for c in ("ids", "size", "copies")), strict=True):
        if len(n):
            at = np.searchsorted(ids, own)
            size[at] += n
            copies[at] += rows
    return pa.table({"id": ids, "total": total, "n": size, "copies": copies})


def summed(texts: DataFrame, ratios: Ratios, kind: str) -> DataFrame:
    """Of texts (id, text): id, total log-ratio, distinct bigrams n, and rows of the id, over which both are averaged."""
    bits = ratios.bits

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, found = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary()).to_pylist()
            for a, b in slices([len(t or b"") for t in found], CHUNK_BYTES):
                yield sent(chunk, ids[a:b], grams(found[a:b]), bits)
                chunk += 1

    # One plan at every size: the ratios grow with the corpus, so they are never broadcast. They lie in buckets of the range.
    blocks = ratios.table.rows.select("range", "keys", F.col(kind).alias("ratio")).groupBy("range")
    answers = blocks.cogroup(texts.mapInArrow(send, SENT).groupBy("range")).applyInArrow(answered, ANSWER)
    # Sums are the ids', whatever chunk they come from.
    sums = answers.groupBy("chunk").applyInArrow(gathered, SUMS)
    copies = F.sum("copies")
    return sums.groupBy("id").agg((F.sum("total") / copies).alias("total"), (F.sum("n") / copies).cast("long").alias("n"), copies.alias("copies"))


@dataclass
class Model:
    """The log-ratios, if there are any, and the calibration curve."""

    ratios: Ratios | None
    curve: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio normalised by length: per word, per root of words, and its order of magnitude."""
    n = np.maximum(n, 1)
    return np.stack([total / n, total / np.sqrt(n), np.sign(total) * np.log1p(np.abs(total))], 1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve with a small ridge, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Count and calibrate on the labelled documents that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    # One plan at every size: labels grow with the corpus, so they are never broadcast.
    train = new_table(docs.sparkSession).add(docs.where(~held_out()).select("doc_id", "text").join(marks.hint("merge"), "doc_id").select(
        "toxic", "text", (F.coalesce(remainder(), F.lit(0)) == 3).cast("int").alias("late"), row_key().alias("row_key")))
    sample = new_table(docs.sparkSession)
    try:
        return learn_from(train, sample)
    finally:
        train.drop()
        sample.drop()


def learn_from(train: Table, sample: Table) -> Model:
    """Learn from the rows of `train` (toxic, text, late, row_key), which is dropped early; `sample` gets the rows to calibrate on."""
    rows = train.rows
    totals = {(r["toxic"], r["late"]): r["n"] for r in rows.groupBy("toxic", "late").agg(F.count(F.lit(1)).alias("n")).collect()}
    early = tuple(float(totals.get((c, 0), 0)) for c in (0, 1))
    every = tuple(early[c] + totals.get((c, 1), 0) for c in (0, 1))
    rate = every[1] / max(1.0, sum(every))
    plain = np.array([0, 0, 0, np.log((rate + 1e-9) / (1 - rate + 1e-9))])
    if not all(every):
        return Model(None, plain, np.zeros(3), np.ones(3))
    share = min(1.0, CALIBRATION_ROWS / max(1.0, sum(every) - sum(early)))
    sample.add(rows.where("late = 1").where(F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        (F.shiftleft(F.xxhash64("row_key", "text"), 1) + F.col("toxic")).alias("id"), "text"))
    parts = min(GRAM_PARTS, 1 << (pieces(measure(rows).text_bytes, PART_BYTES) - 1).bit_length())
    tables = counted(rows, parts)
    train.drop()
    ratios = log_ratios(tables, parts, {"a": every} | ({"e": early} if all(early) else {}))
    x = y = np.zeros(0)
    if all(early):
        # Rows of equal id and class have equal sums, each counted as often as it occurs.
        with freeing(sample.spark):
            seen = summed(sample.rows, ratios, "e").toArrow()
        copies = seen["copies"].to_numpy()
        x, y = np.repeat(features(seen["total"].to_numpy(), seen["n"].to_numpy()), copies, 0), np.repeat(seen["id"].to_numpy() & 1, copies).astype(float)
    if not 0 < y.sum() < len(y):
        return Model(ratios, np.array([0, 4.0, 0, plain[3]]), np.zeros(3), np.ones(3))
    center, scale = x.mean(0), x.std(0) + 1e-9
    return Model(ratios, logistic((x - center) / scale, y), center, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, log-likelihood ratio, distinct bigrams, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), content_key().alias("id"), "text")
    if model.ratios is None:
        sums = rows.select("doc_id", "held_out", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    else:
        # Rows of one id are equal in doc_id and text, so each gets the same, and they are in one part.
        spark, path = docs.sparkSession, work_path(docs.sparkSession, "sums")
        parts = min(ROW_PARTS, pieces(measure(docs).text_bytes, PART_BYTES))
        for part in range(parts):
            found = summed(rows.where(F.pmod(F.xxhash64(row_key()), F.lit(parts)) == part).select("id", "text"), model.ratios, "a")
            with freeing(spark):
                found.write.mode("append").parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        sums = rows.select("id", "doc_id", "held_out").join(found.hint("merge"), "id").select("doc_id", "held_out", "total", "n")
    curve, n = [float(w) for w in model.curve], F.greatest(F.col("n"), F.lit(1))
    values = (F.col("total") / n, F.col("total") / F.sqrt(n), F.signum("total") * F.log1p(F.abs("total")))
    z = sum((w * (v - float(c)) / float(s) for w, v, c, s in zip(curve[:-1], values, model.center, model.scale, strict=True)), F.lit(curve[-1]))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return sums.select(
        "doc_id", "held_out", F.col("total").alias("log_ratio"), F.col("n").alias("n_words"), p.alias("score"), (p >= LIMIT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels, then score every document."""
    model = learn(docs, labels)
    try:
        return score(docs, model)
    finally:
        if model.ratios is not None:
            model.ratios.table.drop()
