"""Per-session metrics and the health score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import merged
from .detectors import parents


def session_metrics(trace: DataFrame) -> DataFrame:
    """Event, edge, merge and tool-call counts per session (A1)."""
    n = F.size(parents(trace))
    return trace.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(n).cast("bigint").alias("edges"),
        F.count_if(n > 1).alias("merge_events"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls"),
    )


def branches(trace: DataFrame) -> DataFrame:
    """Parents with more than one child, per session (A2)."""
    links = trace.select("session_id", F.explode(parents(trace)).alias("parent"))
    return (
        links.groupBy("session_id", "parent").agg(F.count(F.lit(1)).alias("children"))
        .groupBy("session_id").agg(F.count_if(F.col("children") > 1).alias("branches"))
    )


def tool_counts(trace: DataFrame) -> DataFrame:
    """Calls per tool, in long form (A3)."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unknown"))
    return (
        trace.filter(F.col("kind") == "tool_call")
        .groupBy("session_id", name.alias("tool")).agg(F.count(F.lit(1)).alias("calls"))
    )


def usage_totals(trace: DataFrame) -> DataFrame:
    """Sum of every usage counter, in long form (A4)."""
    return (
        trace.select("session_id", F.explode("usage").alias("counter", "amount"))
        .groupBy("session_id", "counter").agg(F.sum("amount").alias("total"))
    )


def health(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Score from 100 down by finding severity; sessions without findings keep 100 (A5)."""
    penalty = F.create_map(*[F.lit(x) for pair in fv.PENALTY.items() for x in pair])[F.col("severity")]
    lost = findings.groupBy("session_id").agg(
        F.sum(penalty).alias("lost"), F.count(F.lit(1)).alias("findings")
    )
    return sessions.join(merged(lost), "session_id", "left").select(
        *sessions.columns,
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
        F.greatest(F.lit(0), F.lit(100) - F.coalesce("lost", F.lit(0))).cast("bigint").alias("workflow_health"),
    )


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Identifiers that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def distinct_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct non-null values per key, in long form."""
    return df.filter(F.col(value).isNotNull()).select(key, value).distinct()


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges per relation."""
    return edges.groupBy("session_id", "relation").agg(F.count(F.lit(1)).alias("edges"))
