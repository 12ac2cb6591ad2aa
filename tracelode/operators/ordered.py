"""Ordered computations per session that stay bounded when one session is huge.

A window partitioned by session alone puts a whole session in one task. Here a
session is cut into *segments* of consecutive rows; each segment is scanned on
its own, a one-row summary per segment is folded in order, and the carry is
joined back. ``segment=None`` means the caller has measured that every session
is small, and a plain window is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, merged

# Rows of one session a single task may hold at once.
SEGMENT_ROWS = 250_000
# Segment of rows whose position is null.
NO_POSITION = -(2**62)


@dataclass(frozen=True)
class Running:
    """A running value: ``count`` rows, ``sum`` or ``max`` of a value or its ``last`` non-null one."""

    name: str
    how: str
    value: Column | None = None
    include_current: bool = True


def largest_group(df: DataFrame, *keys: str) -> int:
    """Rows of the biggest group: one partially aggregated pass, one number to the driver."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(row["n"] or 0)


def time_segment(df: DataFrame, ts: str, *keys: str, rows: int = SEGMENT_ROWS) -> Column | None:
    """A time bucket that keeps (key, bucket) groups near ``rows``; None when every group is small."""
    biggest = largest_group(df, *keys)
    if biggest <= rows:
        return None
    span = df.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    # Four times finer than an even spread would need, so bursts still fit.
    buckets = 4 * (biggest // rows + 1)
    width = max(1, (span["hi"] - span["lo"]) // buckets + 1)
    return F.floor((F.unix_micros(ts) - F.lit(span["lo"])) / width)


def seq_segment(seq: str, biggest: int | None, rows: int = SEGMENT_ROWS) -> Column | None:
    """A bucket of consecutive sequence numbers; None when the biggest group is known to be small."""
    if biggest is not None and biggest <= rows:
        return None
    return F.floor(F.col(seq) / rows)


def by_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> tuple[DataFrame, Column | None]:
    """Rows dealt into segments of about ``rows`` consecutive ones, however sparse their positions are.

    Spark samples the order and cuts it into ranges of about equal counts; a range is a segment of each key in it. The
    ranges are stored, as every reader must see the same ones. None when all rows together are one segment.
    """
    rows = rows or SEGMENT_ROWS
    total = df.count()
    if total <= rows:
        return df, None
    ranges = df.repartitionByRange(-(-total // rows), *keys, *order)
    return cut(ranges.withColumn("_range", F.spark_partition_id())), F.col("_range")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[Running], segment: Column | None
) -> DataFrame:
    """Add running values per ``keys`` in ``order``."""
    keys, order = list(keys), list(order)
    parts = keys if segment is None else keys + ["_segment"]
    # Rows without a position come first, as in an ascending window; they have a segment of their own.
    rows = df if segment is None else df.withColumn("_segment", F.coalesce(segment.cast("long"), F.lit(NO_POSITION)))
    base = Window.partitionBy(*parts).orderBy(*order)
    frames = {
        True: base.rowsBetween(Window.unboundedPreceding, 0),
        False: base.rowsBetween(Window.unboundedPreceding, -1),
    }

    def local(v: Running) -> Column:
        frame = frames[v.include_current]
        if v.how == "count":
            return F.count(F.lit(1)).over(frame)
        if v.how == "sum":
            return F.coalesce(F.sum(v.value).over(frame), F.lit(0))
        if v.how == "max":
            return F.max(v.value).over(frame)
        return F.last(v.value, ignorenulls=True).over(frame)

    scanned = rows.select("*", *[local(v).alias(v.name) for v in values])
    if segment is None:
        return scanned

    position = F.struct(*order)

    def summary(v: Running) -> Column:
        if v.how == "count":
            return F.count(F.lit(1))
        if v.how == "sum":
            return F.sum(v.value)
        if v.how == "max":
            return F.max(v.value)
        return F.max_by(v.value, F.when(v.value.isNotNull(), position))

    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)

    def carry(v: Running) -> Column:
        held = F.col("_s_" + v.name)
        if v.how == "max":
            return F.max(held).over(before)
        return F.last(held, ignorenulls=True).over(before) if v.how == "last" else F.sum(held).over(before)

    summaries = rows.groupBy(*parts).agg(*[summary(v).alias("_s_" + v.name) for v in values])
    carries = summaries.select(*parts, *[carry(v).alias("_c_" + v.name) for v in values])
    held = carries.select(*[F.col(p).alias("_k_" + p) for p in parts], *["_c_" + v.name for v in values])
    same = [F.col(p).eqNullSafe(F.col("_k_" + p)) for p in parts]
    joined = scanned.join(merged(held), reduce(lambda x, y: x & y, same), "inner")

    def whole(v: Running) -> Column:
        own, prior = F.col(v.name), F.col("_c_" + v.name)
        if v.how == "max":
            return F.greatest(own, prior)
        return F.coalesce(own, prior) if v.how == "last" else own + F.coalesce(prior, F.lit(0))

    names = {v.name for v in values}
    return joined.select(
        *[c for c in df.columns if c not in names], *[whole(v).alias(v.name) for v in values]
    )


def with_halo(df: DataFrame, position: str, reach: int, biggest: int | None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Cut dense positions (1, 2, ...) into segments, copying each segment's last ``reach`` rows ahead.

    A frame of ``reach`` preceding rows is then exact inside (key, ``_segment``).
    Drop rows with ``_halo`` after the window.
    """
    if biggest is not None and biggest <= rows:
        return df.select("*", F.lit(0).cast("bigint").alias("_segment"), F.lit(False).alias("_halo"))
    own = F.coalesce(F.floor((F.col(position) - 1) / rows), F.lit(NO_POSITION))
    tail = F.coalesce((F.col(position) - 1) % rows >= rows - reach, F.lit(False))
    targets = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", F.posexplode(targets).alias("_copy", "_segment")).select(
        *df.columns, "_segment", (F.col("_copy") > 0).alias("_halo")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)


def first_ids(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int = 10) -> DataFrame:
    """Up to ``k`` values per group in order, as an array ``evidence`` (L1)."""
    top = first_rows(df, keys, [order], k)
    listed = F.array_sort(F.collect_list(F.struct(F.col("_rank"), F.col(value).alias("v"))))
    return top.groupBy(*keys).agg(F.transform(listed, lambda r: r["v"]).alias("evidence"))


def layered_digest(df: DataFrame, keys: Sequence[str], seq: str, line: Column, fan: int = 4096) -> DataFrame:
    """Order-sensitive digest per group, built in layers of at most ``fan`` members.

    Equal digests mean equal rows in equal order. Three layers cover fan ** 3
    consecutive positions, so no layer collects an unbounded group.
    """
    level = df.select(*keys, F.col(seq).alias("_pos"), F.sha2(line, 256).alias("_d"))
    for depth in range(3):
        group = list(keys) if depth == 2 else list(keys) + ["_block"]
        if depth < 2:
            level = level.withColumn("_block", F.floor(F.col("_pos") / fan))
        ordered = F.array_sort(F.collect_list(F.struct("_pos", "_d")))
        level = level.groupBy(*group).agg(
            F.sha2(F.array_join(F.transform(ordered, lambda r: r["_d"]), ""), 256).alias("_d")
        )
        if depth < 2:
            level = level.withColumnRenamed("_block", "_pos")
    return level.withColumnRenamed("_d", "digest")
