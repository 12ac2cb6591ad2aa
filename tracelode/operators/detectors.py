"""Workflow detectors: trace events in, findings out.

Each detector takes a trace table and returns rows of ``schemas.FINDINGS``.
``detector`` and ``position`` order the findings of a session, so no window
over all findings is needed to number them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..session import merged
from .ordered import SEGMENT_ROWS, Running, by_count, first_ids, largest_group, running, with_halo

REPEAT_WINDOW = 8
REPEAT_MINIMUM = 3


def finding(
    df: DataFrame, detector: int, code: str, severity: str, summary: Column, evidence: Column, position: Column | None = None
) -> DataFrame:
    return df.select(
        "session_id",
        F.lit(detector).alias("detector"),
        (F.lit(0) if position is None else position).cast("bigint").alias("position"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        summary.alias("summary"),
        evidence.alias("evidence"),
    )


def grouped_finding(
    flagged: DataFrame, detector: int, code: str, severity: str, summary: Callable[[Column], Column]
) -> DataFrame:
    """One finding per session over flagged events (session_id, seq, id): total count and first ten ids."""
    totals = flagged.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    listed = totals.join(merged(first_ids(flagged, ["session_id"], "seq", "id")), "session_id")
    return finding(listed, detector, code, severity, summary(F.col("n")), F.col("evidence"))


def call_outcomes(trace: DataFrame) -> DataFrame:
    """Per tool call id: whether any result failed, whether any succeeded."""
    results = trace.filter((F.col("kind") == "tool_result") & F.col("parent_id").isNotNull())
    return results.groupBy("session_id", F.col("parent_id").alias("id")).agg(
        F.bool_or("is_error").alias("failed"), F.bool_or(~F.col("is_error")).alias("succeeded")
    )


def tool_calls(trace: DataFrame, biggest: int | None = None) -> DataFrame:
    """Tool calls with their dense ordinal in the session and their outcome flags."""
    calls = trace.filter(F.col("kind") == "tool_call").select("session_id", "seq", "id", "name", "signature")
    # Positions of calls are sparse, and those of some formats far apart, so segments go by counted rows.
    segment = None
    if biggest is None or biggest > SEGMENT_ROWS:
        calls, segment = by_count(calls, ["session_id"], ["seq"])
    numbered = running(calls, ["session_id"], ["seq"], [Running("call_no", "count")], segment)
    return numbered.join(merged(call_outcomes(trace)), ["session_id", "id"], "left").select(
        "session_id", "seq", "id", "name", "signature", "call_no",
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce("succeeded", F.lit(False)).alias("succeeded"),
    )


def repeated_action(trace: DataFrame, biggest: int | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Three or more calls of one signature among the last eight, two failed and none recovered."""
    calls = tool_calls(trace, biggest) if calls is None else calls
    haloed = with_halo(calls, "call_no", REPEAT_WINDOW - 1, biggest)
    frame = Window.partitionBy("session_id", "_segment").orderBy("call_no").rowsBetween(1 - REPEAT_WINDOW, 0)
    recent = F.collect_list(F.struct("signature", "failed", "succeeded", "id")).over(frame)
    same = haloed.withColumn("recent", recent).filter(~F.col("_halo")).withColumn(
        "same", F.filter("recent", lambda r: r["signature"] == F.col("signature"))
    )
    hit = same.filter(
        (F.size("same") >= REPEAT_MINIMUM)
        & (F.size(F.filter("same", lambda r: r["failed"])) >= REPEAT_MINIMUM - 1)
        & ~F.exists("same", lambda r: r["succeeded"])
    )
    first = hit.groupBy("session_id", "signature").agg(
        F.min(F.struct("call_no", "name", F.transform("same", lambda r: r["id"]).alias("ids"))).alias("f")
    )
    summary = F.format_string(
        "Repeated %s action %d times in a short window",
        F.coalesce(F.nullif(F.col("f.name"), F.lit("")), F.lit("tool")), F.size("f.ids"),
    )
    return finding(first, 1, "repeated_action", "warning", summary, F.col("f.ids"), F.col("f.call_no"))


def alternating_loop(trace: DataFrame, biggest: int | None = None, calls: DataFrame | None = None) -> DataFrame:
    """First A-B-A-B over four consecutive calls with at least two failures."""
    calls = tool_calls(trace, biggest) if calls is None else calls
    haloed = with_halo(calls, "call_no", 3, biggest)
    frame = Window.partitionBy("session_id", "_segment").orderBy("call_no").rowsBetween(-3, 0)
    four = F.collect_list(F.struct("signature", "failed", "id")).over(frame)
    hit = haloed.withColumn("c", four).filter(
        ~F.col("_halo")
        & (F.size("c") == 4)
        & (F.get("c", 0)["signature"] == F.get("c", 2)["signature"])
        & (F.get("c", 1)["signature"] == F.get("c", 3)["signature"])
        & (F.get("c", 0)["signature"] != F.get("c", 1)["signature"])
        & (F.size(F.filter("c", lambda r: r["failed"])) >= 2)
    )
    first = hit.groupBy("session_id").agg(
        F.min(F.struct("call_no", F.transform("c", lambda r: r["id"]).alias("ids"))).alias("f")
    )
    return finding(
        first, 2, "alternating_loop", "warning", F.lit("Detected an A-B-A-B tool-call loop"), F.col("f.ids")
    )


def error_events(trace: DataFrame) -> DataFrame:
    """Error events with ``recovered``: a later success of the same signature exists (D3)."""
    results = trace.filter((F.col("kind") == "tool_result") & F.col("parent_id").isNotNull())
    calls = trace.filter(F.col("kind") == "tool_call").select(
        "session_id", F.col("id").alias("parent_id"), "signature"
    )
    signed = results.select("session_id", "seq", "id", "parent_id", "is_error").join(
        merged(calls), ["session_id", "parent_id"]
    )
    last_success = (
        signed.filter(~F.col("is_error")).groupBy("session_id", "signature").agg(F.max("seq").alias("last_ok"))
    )
    failed = signed.filter("is_error").select("session_id", "id", "signature")
    recovered = failed.join(merged(last_success), ["session_id", "signature"]).select("session_id", "id", "last_ok")
    errors = trace.filter("is_error").select("session_id", "seq", "id")
    return errors.join(merged(recovered), ["session_id", "id"], "left").select(
        "session_id", "seq", "id", F.coalesce(F.col("last_ok") > F.col("seq"), F.lit(False)).alias("recovered")
    )


def unrecovered_errors(trace: DataFrame) -> DataFrame:
    """Errors the session never got past (D3)."""
    errors = error_events(trace)
    totals = errors.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("recovered")).alias("open")
    )
    listed = first_ids(errors.filter(~F.col("recovered")), ["session_id"], "seq", "id")
    healed = F.col("total") - F.col("open")
    summary = F.concat(
        F.format_string("Observed %d unrecovered error(s)", "open"),
        F.when(
            healed > 0,
            F.format_string(" (%d total; %d later recovered by a retry of the same tool)", F.col("total"), healed),
        ).otherwise(""),
    )
    return finding(totals.join(merged(listed), "session_id"), 3, "errors", "warning", summary, F.col("evidence"))


def user_correction(trace: DataFrame, phrases: tuple[str, ...] = fv.CORRECTION_PHRASES) -> DataFrame:
    """User turns that read like a correction."""
    flagged = trace.filter((F.col("role") == "user") & tx.has_any(F.col("text"), phrases))
    return grouped_finding(
        flagged.select("session_id", "seq", "id"), 4, "user_correction", "info",
        lambda n: F.format_string("Detected %d likely user correction turns", n),
    )


def last_events(trace: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns of the last event of every session."""
    return trace.groupBy("session_id").agg(F.max_by(F.struct(*columns), "seq").alias("last")).select(
        "session_id", "last.*"
    )


def dead_end(trace: DataFrame) -> DataFrame:
    """Sessions whose last event is an error."""
    last = last_events(trace, "id", "is_error").filter("is_error")
    return finding(
        last, 5, "dead_end", "critical", F.lit("Session ended on an error or abort"), F.array("id")
    )


def parents(trace: DataFrame) -> Column:
    """Declared parents of an event: the list when there is one, else the single parent."""
    single = F.when(F.length("parent_id") > 0, F.array("parent_id")).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.col("parent_ids"), single) if "parent_ids" in trace.columns else single


def dangling_events(trace: DataFrame) -> DataFrame:
    """Events with at least one parent that is not in the session."""
    links = trace.select("session_id", "seq", "id", F.explode(parents(trace)).alias("parent"))
    known = trace.select("session_id", F.col("id").alias("parent"))
    return links.join(merged(known), ["session_id", "parent"], "left_anti").select("session_id", "seq", "id").distinct()


def dangling_edges(trace: DataFrame) -> DataFrame:
    """Sessions with events whose parent is absent."""
    return grouped_finding(
        dangling_events(trace), 99, "dangling_edges", "info",
        lambda n: F.format_string("Graph has %d events whose parent is absent", n),
    )


def _needs_text(trace: DataFrame) -> bool:
    return "text" in trace.columns and "role" in trace.columns


def core_findings(trace: DataFrame, biggest: int | None = None) -> DataFrame:
    """All detectors that apply to any trace."""
    calls = tool_calls(trace, biggest)
    parts = [
        repeated_action(trace, biggest, calls),
        alternating_loop(trace, biggest, calls),
        unrecovered_errors(trace),
        dead_end(trace),
        dangling_edges(trace),
    ]
    if _needs_text(trace):
        parts.append(user_correction(trace))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def measured(trace: DataFrame) -> int:
    """Rows of the biggest session; pass it as ``biggest`` to pick plain or segmented windows."""
    return largest_group(trace, "session_id")
