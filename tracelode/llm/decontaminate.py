r"""Benchmark decontamination by winnowing, in native expressions.

Every window of an item's words that must be found has m words: SPAN of them, or all of a shorter item's. For a
length m, a text is fingerprinted by hashes of its runs of k = ceil(m / 2) words: of each m - k + 1 consecutive
hashes the smallest is kept, wherever in them it stands. Any m words that two texts share hold the same hashes, so
both keep one in the same place: no shared span of m words is missed. Fingerprints of documents and items are
joined, each hit is extended to the windows of m words around it, and these are joined on the words themselves,
so that nothing rests on a hash. Items that share a window are joined as a class, so a passage of many items costs
one row per document.

The fingerprints of the items are a stored table: Spark broadcasts it where its size is below the session's
threshold and shuffles it otherwise, splitting hot fingerprints (AQE). Only documents with a hit are read as text a
second time.

Defined cases: null text has no words, and an item without words no windows; overlapping places all count; a
repeated row has its own result each time; rows of one item_id are one item; an item whose id is null makes hits, but
has no name to be counted or listed; empty tables give no rows, or rows without hits. Columns other than doc_id, text
and item_id are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import let, whole
from tracelode.llm.license_scan import words
from tracelode.session import cut

#: Words of a window; shorter items are one window.
SPAN = 10
KEY = ["key", "check"]


def _sliding(values: Column, width: int, pick) -> Column:
    """`pick` (least, greatest) of each `width` consecutive values, by doubling; nulls are passed over."""
    def doubled(step: int):
        return lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda a, b: pick(a, b))

    done = 1
    while done < width:
        step = min(done, width - done)
        values, done = let(values, doubled(step)), done + step
    return let(values, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - (width - 1), F.lit(0))))


def run_length(m: int) -> int:
    """Words of a hashed run, for shared spans of m words."""
    return (m + 1) // 2


def marks(w: Column, m: int) -> Column:
    """At each run's place its hash if the run is a fingerprint, else null; nothing for texts of fewer than m words."""
    k = run_length(m)
    width = m - k + 1
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.lit(m), *[F.get(w, i + j) for j in range(k)]))
    pad = F.array_repeat(F.lit(None).cast("long"), width - 1)

    def kept(h: Column) -> Column:
        # A run is the smallest of one of its windows if the greatest of its windows' minima is its own hash.
        least = _sliding(h, width, F.least)
        reached = _sliding(F.concat(pad, least, pad), width, F.greatest)
        return F.zip_with(h, reached, lambda a, b: F.when(a == b, a))

    return F.when(F.size(w) >= m, let(hashes, kept)).otherwise(F.array().cast("array<bigint>"))


def windows(w: Column, starts: Column, m: int) -> Column:
    """The windows of m words at the given starts: m, start and their words, as text."""
    return F.transform(starts, lambda s: F.struct(
        F.lit(m).alias("m"), s.cast("long").alias("start"), F.array_join(F.slice(w, s + 1, m), " ").alias("words")))


def all_starts(w: Column, m: int) -> Column:
    return F.when(F.size(w) >= m, F.sequence(F.lit(0), F.size(w) - m)).otherwise(F.array().cast("array<int>"))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, 128 bits that stand for the row's id and text, and the text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("key"), F.xxhash64(F.lit(1), "text", doc_id).alias("check"),
        whole("text").alias("text"),
    )


def items_of(items: DataFrame, span: int) -> DataFrame:
    """item_id, words and m of each item that has words."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(whole("text")).alias("w"))
    return cut(rows.where(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(span))))


def fingerprints(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """`keep`, m, and place and hash of every fingerprint of the words w."""
    by_length = F.array(*[F.struct(F.lit(m).alias("m"), marks(F.col("w"), m).alias("marks")) for m in lengths])
    # Outer explodes: before the plain ones Spark tests the arrays' sizes, which would compute them twice.
    each = rows.select(*keep, F.explode_outer(by_length).alias("x")).select(*keep, "x.m", F.posexplode_outer("x.marks").alias("place", "print"))
    return each.where(F.col("print").isNotNull())


def item_windows(items: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (m, words, class), and the items of each class (class, item_id)."""
    of_length = [F.when(F.col("m") == m, windows(F.col("w"), all_starts(F.col("w"), m), m)) for m in lengths]
    each = items.select("item_id", F.explode(F.coalesce(*of_length)).alias("x"))
    having = each.groupBy("x.m", "x.words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    having = cut(having.withColumn("class", F.sha2(F.to_json("items"), 256)))
    return having.select("m", "words", "class"), having.select("class", "items").distinct().select("class", F.explode("items").alias("item_id"))


def hits(texts: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """key, check, m and the places of fingerprints that items have too."""
    known = cut(fingerprints(items.withColumnRenamed("m", "own"), lengths, ["own"]).where("own = m").select("print").distinct())
    found = fingerprints(texts.select(*KEY, words(F.col("text")).alias("w")), lengths, KEY).join(known, "print", "left_semi")
    return cut(found.groupBy(*KEY, "m").agg(F.collect_set("place").alias("places")))


def extended(texts: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """key, check, and every window of m words around a hit: m, start, words; a repeated row's ones are repeated."""
    def around(m: int) -> Column:
        starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p - (m - run_length(m)), p))))
        return windows(F.col("w"), F.filter(starts, lambda s: (s >= 0) & (s <= F.size("w") - m)), m)

    by_length = [F.when(F.col("m") == m, around(m)) for m in lengths]
    near = texts.select(*KEY, "text").join(found, KEY).select(*KEY, "m", "places", words(F.col("text")).alias("w"))
    return near.select(*KEY, F.explode(F.coalesce(*by_length)).alias("x")).select(*KEY, "x.*")


def merged(spans: Column) -> Column:
    """Sorted spans joined where they touch or overlap; ends exclusive."""
    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<start: bigint, end: bigint>>"), add)


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (start and end word of every hit run), item_ids."""
    texts = texts_of(docs)
    base = texts.select("doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = items_of(benchmark, span)
    # At most SPAN lengths, whatever the benchmark's size.
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())
    none = F.array().cast("array<string>")
    if not lengths:
        spans = F.array().cast("array<struct<start: bigint, end: bigint>>")
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), spans.alias("spans"), none.alias("item_ids"))
    parts, classes = item_windows(items, lengths)
    same = cut(extended(texts, hits(texts, items, lengths), lengths).join(parts, ["m", "words"]).select(*KEY, "m", "start", "class"))
    # A document has at most as many windows as words.
    place = F.struct("start", (F.col("start") + F.col("m")).alias("end"))
    spans = same.groupBy(*KEY).agg(F.array_sort(F.collect_set(place)).alias("all")).select(*KEY, merged(F.col("all")).alias("spans"))
    named = same.select(*KEY, "class").distinct().join(classes, "class").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return base.join(spans, KEY, "left").join(named, KEY, "left").select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )
