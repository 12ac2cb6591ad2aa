"""License notices by an exact set-similarity join of text blocks with templates, in native expressions.

A block is a run of words of fixed length; blocks overlap by half, so a passage as long as any template lies
whole in one. A block meets a template when it holds the threshold's share of the template's distinct words.
Template words are ordered by their frequency in the corpus, counted over all documents. Of a template with n
words that needs c of them, a block must hold one of the n - c + 1 rarest (prefix filter), must have c words
(length filter), and at the first such word that both have, that word and those after it in the template and in
the block's words of the same order must still suffice (positional filter). Blocks that pass are verified on their
words. Of the templates of one family that a block meets, the best counts.

Templates are a small fixed list, so their index may be broadcast; only documents that have a prefix word are
ever cut into blocks.

Defined cases: null text has no words; phrases are found at every place, overlapping ones too; a document is
one row however often it repeats; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.common import content_key, let, whole
from tracelode.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by family and label: public wordings, as words.
TEMPLATES = (
    ("apache", "apache-2.0", "apache license version 2 0"),
    ("apache", "apache-2.0", "licensed under the apache license 2 0"),
    ("apache", "apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd", "licensed under the bsd license"),
    ("bsd", "bsd", "released under the bsd license"),
    ("cc", "cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc", "cc-by-4.0", "licensed under cc by 4 0"),
    ("cc", "cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc", "cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc", "cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc", "cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "cc0-1.0", "dedicated to the public domain under the cc0 1 0 universal waiver"),
    ("gnu", "agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("gnu", "agpl-3.0", "gnu affero general public license version 3"),
    ("gnu", "gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gnu", "gpl-2.0", "gnu general public license version 2"),
    ("gnu", "gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gnu", "gpl-3.0", "gnu general public license version 3"),
    ("gnu", "lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("gnu", "lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("gnu", "lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("gnu", "lgpl-3.0", "gnu lesser general public license version 3"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mpl-2.0", "mozilla public license version 2 0"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD_PERCENT = 90
BLOCK = 48


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def needed(n: int, percent: int = THRESHOLD_PERCENT) -> int:
    return -(-percent * n // 100)


def _phrase_places(w: Column, tokens: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        match = F.get(w, i) == tokens[0]
        for k, token in enumerate(tokens[1:], 1):
            match = match & F.coalesce(F.get(w, i + k) == token, F.lit(False))
        return match

    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
    hits = F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))
    none = F.array().cast("array<struct<label: string, start: bigint>>")
    return F.when(F.array_contains(w, tokens[0]) & F.array_contains(w, tokens[-1]), hits).otherwise(none)


def places(w: Column) -> Column:
    """(label, start) of every phrase, wherever its words stand consecutively."""
    return F.concat(*[_phrase_places(w, phrase.split(), label) for phrase, label in PHRASES.items()])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("content_key"), words(whole("text")).alias("w"))


def global_order(docs: DataFrame) -> list[str]:
    """Template words from the rarest to the most frequent, by documents that have them; as many as templates have."""
    vocabulary = sorted({t for _, _, text in TEMPLATES for t in text.split()})
    found = F.array_intersect(words(whole("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["token"]: r["n"] for r in rows}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def index_of(docs: DataFrame, percent: int, order: list[str]) -> DataFrame:
    """Prefix words of every template: token, template, its label, words in order, words needed, and position."""
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for k, (family, label, text) in enumerate(TEMPLATES):
        tokens = sorted(set(text.split()), key=rank.get)
        least = needed(len(tokens), percent)
        rows += [(tokens[i], k, family, label, tokens, least, i) for i in range(len(tokens) - least + 1)]
    schema = "token string, template int, family string, label string, tokens array<string>, least int, position int"
    return docs.sparkSession.createDataFrame(rows, schema)


def candidates(texts: DataFrame, index: DataFrame, prefix: list[str], order: list[str]) -> DataFrame:
    """content_key, start, length and words of blocks, each with a template that the filters don't exclude.

    A block's words are those of the global order, in it; no other word is in a template.
    """
    rare = F.array(*map(F.lit, prefix))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK // 2)), lambda i: F.struct(
        i.cast("long").alias("start"), F.slice("w", i + 1, BLOCK).alias("b")))
    blocks = texts.where(F.arrays_overlap("w", rare)).select(
        "content_key", F.explode(F.filter(cuts, lambda x: F.arrays_overlap(x["b"], rare))).alias("x"))
    blocks = blocks.select("content_key", "x.start", F.array_intersect(F.array(*map(F.lit, order)), F.col("x.b")).alias("b"), F.size("x.b").alias("length"))
    probes = blocks.select("*", F.explode(F.array_intersect("b", rare)).alias("token"))
    first = ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("position")), "b")
    left = F.least(F.size("tokens") - F.col("position") - 1, F.size("b") - F.array_position("b", F.col("token")))
    return probes.join(F.broadcast(index), "token").where(
        (F.size("b") >= F.col("least")) & first & (1 + left >= F.col("least")))


def matches(found: DataFrame) -> DataFrame:
    """content_key, start and end word of each candidate block that meets a template, its label and the containment.

    Notices of one family share most of their words. Of those that a block meets, the one with the greatest
    containment counts, then the one with the most words; so a GPL notice is no LGPL one, and an LGPL notice no GPL one.
    """
    hits = found.withColumn("common", F.size(F.array_intersect("b", F.col("tokens")))).where(F.col("common") >= F.col("least"))
    hits = hits.withColumn("containment", F.col("common") / F.size("tokens"))
    rivals = Window.partitionBy("content_key", "start", "family").orderBy(F.desc("containment"), F.desc("common"))
    return hits.withColumn("place", F.rank().over(rivals)).where("place = 1").select(
        "content_key", "start", (F.col("start") + F.col("length")).alias("end"), "label", "containment").distinct()


def scan(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document: n_words, places of phrases, labels, matched blocks and score."""
    order = global_order(docs)
    index = index_of(docs, percent, order)
    prefix = sorted({r["token"] for r in index.select("token").collect()})
    texts = texts_of(docs)
    base = texts.select("doc_id", "content_key", F.size("w").cast("long").alias("n_words"), let(F.col("w"), places).alias("places"))
    blocks = matches(candidates(texts, index, prefix, order))
    # A document has as many blocks as its text gives; a row of labels is bounded by the templates.
    found = cut(blocks).groupBy("content_key").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count(F.lit(1)).alias("n_blocks"))
    starts = F.transform("places", lambda p: p["start"])
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    method = F.coalesce("found", F.array().cast("array<string>"))
    return base.join(found, "content_key", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, method)), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        "places", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
