"""Small tables with the awkward cases, and readers of results."""

import os

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None, langs=None):
    """A documents table of the given texts."""
    n = len(texts)
    rows = [
        (ids[i] if ids else i, texts[i], langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}",
         len(texts[i] or "")) for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def given(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


def by_id(df):
    return {row["doc_id"]: row.asDict() for row in df.collect()}


def clash(df):
    """The same table with extra columns whose names operators may use inside, but for those it has itself."""
    from pyspark.sql import functions as F

    names = ("chunk", "h", "w", "x", "shard", "data", "fp", "row_key", "kept", "host", "suspect", "part", "rank", "n", "spans", "below", "at", "buckets", "label", "score")
    return df.select("*", *[F.lit("x").alias(name) for name in names if name not in df.columns])


AWKWARD = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "a b c", "  a\tb  ", "é ü ß", "x" * 30_000, "word " * 20_000,
    "5.", "<|endoftext|> don't it's 12é ΑΣ ́a", "line\n\nline\nline\r\nend ", "ünïcödé " * 30,
]
