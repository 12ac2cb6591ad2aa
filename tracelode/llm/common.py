"""What several operators share: words, bound values, sizes of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once, although a lambda inside uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text that is not null, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that spreads rows evenly: the id, or the text's hash where the id is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def content_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One number for rows of equal id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


@dataclass(frozen=True)
class Size:
    """Rows and text bytes of a table, and its smallest and largest id."""

    rows: int
    text_bytes: int


def measure(docs: DataFrame) -> Size:
    """Row and byte counts, one row for the driver; they only set how finely the work is dealt out."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return Size(row["n"], row["b"] or 0)


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` make up `total`."""
    return max(least, -(-total // each))
