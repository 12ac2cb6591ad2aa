"""Activity steps: the readable timeline of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import basename
from ..names import DEFAULT, Names
from ..session import cut
from .ordered import Running, by_count, running

GAP_BOUNDARY = "capture_health.missing_provider_payload"


def phase() -> Column:
    """Timeline phase of an event; usage rows have none."""
    obs, boundary = F.col("observation"), F.coalesce("boundary", F.lit(""))
    toolish = F.coalesce(F.col("source_category") == "tool_result", F.lit(False)) | boundary.rlike(r"(^|[._])tool([._]|$)")
    return (
        F.when(obs == "capture_health", "health").when(obs == "response", "outcome")
        .when(obs.isin("payload", "dispatch"), "boundary").when(obs == "usage", None)
        .when(obs.isin("read", "transform", "inclusion"), "process")
        .when(obs.isin("load", "inventory"), F.when(toolish, "process").otherwise("input"))
        .otherwise("health")
    )


def runtime(adapter: Column) -> Column:
    """Agent runtime behind an adapter id (P5)."""
    a = F.lower(F.coalesce(adapter, F.lit("")))
    return (
        F.when(a == "pi", "pi").when(a.contains("claude"), "claude_code").when(a.contains("codex"), "codex")
        .when(a.contains("cursor"), "cursor_agent").otherwise("unknown")
    )


def shown_range() -> Column:
    """Source range with its unit: lines only when the match method says so."""
    r, method = F.col("source_range"), F.coalesce("match_method", F.lit(""))
    by_line = method.isin(*fv.LINE_METHODS) | method.contains("line_range")
    return F.when(
        r["start"].isNotNull() & r["end"].isNotNull(),
        F.struct(r["start"].alias("start"), r["end"].alias("end"), F.when(by_line, "line").otherwise("byte").alias("unit")),
    )


def _set(c: str) -> Column:
    return F.when(F.length(c) > 0, F.col(c))


def title(step: Column, span: Column) -> Column:
    """Human title of a step."""
    alias = F.coalesce(_set("source_alias"), _set("source_key"), _set("boundary"), F.col("observation"))
    short, boundary = basename(alias), F.coalesce("boundary", F.lit(""))
    words = F.when(
        span["unit"] == "line", F.format_string("L%d–L%d", span["start"], span["end"])
    ).when(span.isNotNull(), F.format_string("bytes [%d, %d)", span["start"], span["end"]))
    category = F.coalesce("source_category", F.lit(""))
    path = F.coalesce(_set("source_path"), _set("source_alias"))
    health = (
        F.when(F.length("unsupported_boundary") > 0, F.concat(F.lit("Capture gap: "), "unsupported_boundary"))
        .when(boundary == "source_matching.eviction", "Capture health: source matching eviction")
        .when(F.length("source_alias") > 0, F.concat(F.lit("Capture health: "), short))
        .otherwise(F.concat(F.lit("Capture health: "), F.coalesce(_set("boundary"), F.lit("gap"))))
    )
    tool = F.when(
        F.length("tool_call_id") > 0, F.concat(F.lit("tool "), F.substring("tool_call_id", 1, 8))
    ).otherwise("tool/process")
    process = (
        F.when(words.isNotNull(), F.concat_ws(": ", short, words))
        .when(_set("source_alias").isNotNull() | _set("source_key").isNotNull(), F.concat(short, F.lit(" · range unknown")))
        .otherwise(F.concat_ws(" · ", tool, F.coalesce(_set("boundary"), F.col("observation"))))
    )
    given = (
        F.when(boundary.contains("prompt") | (category == "user_input"), "User input")
        .when((category == "instructions") | boundary.contains("contextFiles"),
              F.concat(F.lit("Instructions: "), F.coalesce(basename(path), F.lit("context"))))
        .when((category == "system_input") | boundary.contains("systemPrompt"), "Assembled system prompt")
        .when((category == "skill") | boundary.contains("skills"),
              F.concat(F.lit("Skill: "), F.coalesce(_set("source_alias"), short)))
        .when(category == "file_input", F.when(
            words.isNotNull(), F.concat(F.lit("Load "), short, F.lit(" ("), words, F.lit(")"))
        ).otherwise(F.concat(F.lit("Load "), short)))
        .otherwise(short)
    )
    return (
        F.when(step == "outcome", "Assistant response")
        .when(step == "boundary", F.when(F.col("observation") == "dispatch", "Provider dispatch").otherwise("Provider request snapshot"))
        .when(step == "health", health).when(step == "process", process).otherwise(given)
    )


def noted_path() -> Column:
    """Path recorded in the notes, if any."""
    return F.trim(F.nullif(F.regexp_extract("notes", r"(?:^|\n)sourcePath=([^\n]+)", 1), F.lit("")))


def step_path() -> Column:
    """Best path of an event: explicit, noted, path-like alias, else the source key."""
    alias = _set("source_alias")
    pathlike = alias.contains("/") | alias.contains("\\") | alias.rlike(r"(?i)\.[a-z0-9]+$")
    return F.coalesce(_set("source_path"), noted_path(), F.when(pathlike, alias), _set("source_key"))


def harness_path() -> Column:
    """Path of an instruction, file or skill source without touching a disk."""
    looks = lambda p: p.contains("/") | p.contains("\\")
    explicit = F.coalesce(F.col("source_path"), noted_path())
    return F.when(looks(explicit), explicit).when(
        F.col("source_category").isin("instructions", "file_input") & looks(F.col("source_alias")), F.col("source_alias")
    )


def recorded_steps(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """One step per event that has a phase."""
    rows = events.filter(F.col("schema_version") == names.context_schema).withColumns(
        {"phase": phase(), "span": shown_range()}
    ).filter(F.col("phase").isNotNull())
    return rows.select(
        "session_id", "event_id", F.col("producer_seq").cast("double").alias("seq"), "wall_time", "phase",
        runtime(F.col("adapter_id")).alias("agent_runtime"), title(F.col("phase"), F.col("span")).alias("title"),
        step_path().alias("path"), F.col("span").alias("range"),
        F.when(F.length("tool_call_id") > 0, F.coalesce(_set("source_alias"), _set("boundary"), F.lit("tool"))).alias("tool_name"),
        "evidence", "request_id", F.coalesce(F.length("raw_text") > 0, F.lit(False)).alias("has_message_preview"),
        "coverage", "boundary", "adapter_id", "agent_id", "attempt_id", "tool_call_id", "match_method", "ambiguity",
        "parent_event_ids", "usage_input_tokens", "usage_output_tokens", "usage_cached_tokens", "unsupported_boundary",
        F.lit(False).alias("derived"),
    )


def turn_flags(steps: DataFrame) -> DataFrame:
    """Per turn: whether it has work, a boundary or a reported gap, and where it ends."""
    reported = (F.col("phase") == "health") & (
        F.lower("title").contains("no provider payload")
        | F.coalesce(F.col("unsupported_boundary") == "before_provider_request", F.lit(False))
        | F.coalesce(F.col("boundary") == GAP_BOUNDARY, F.lit(False))
    )
    return steps.filter(F.length("request_id") > 0).groupBy("session_id", "request_id").agg(
        F.bool_or(F.col("phase").isin("input", "outcome", "process")).alias("has_io"),
        F.bool_or(F.col("phase") == "boundary").alias("has_boundary"),
        F.bool_or(reported).alias("reported"),
        F.max("seq").alias("max_seq"), F.max_by("wall_time", "seq").alias("wall_time"),
        F.min_by(F.struct("agent_runtime", "adapter_id", "agent_id"), "seq").alias("first"),
    )


def gap_steps(steps: DataFrame) -> DataFrame:
    """A derived health step per turn with work but no payload, unless already reported."""
    open_turns = turn_flags(steps).filter("has_io and not has_boundary and not reported")
    values = {
        "session_id": F.col("session_id"), "event_id": F.concat(F.lit("derived:gap:"), "request_id"),
        "seq": F.col("max_seq") + 0.5, "wall_time": F.col("wall_time"), "phase": F.lit("health"),
        "agent_runtime": F.col("first.agent_runtime"), "title": F.lit("Capture gap: no provider payload snapshot"),
        "evidence": F.lit("unknown"), "request_id": F.col("request_id"), "has_message_preview": F.lit(False),
        "coverage": F.lit("unsupported"), "boundary": F.lit(GAP_BOUNDARY), "adapter_id": F.col("first.adapter_id"),
        "agent_id": F.col("first.agent_id"),
        "ambiguity": F.lit("Derived from absence of payload/dispatch for this turn"),
        "parent_event_ids": F.array().cast("array<string>"),
        "unsupported_boundary": F.lit("before_provider_request"), "derived": F.lit(True),
    }
    return open_turns.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in steps.schema
    ])


def activity_steps(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """Recorded and derived steps (U3); ``ordered_steps`` numbers them."""
    steps = recorded_steps(events, names)
    return steps.unionByName(gap_steps(steps))


#: How steps are read: by sequence, time, recorded before derived, and the id between rows alike in these.
STEP_ORDER = ("seq", "wall_time", "derived", "event_id")


def ordered_steps(steps: DataFrame) -> DataFrame:
    """Steps with their position in the session, from 1 (L3).

    Sessions are cut by counted rows, so one with most of the rows is not numbered in one task.
    """
    rows, segment = by_count(cut(steps), ["session_id"], STEP_ORDER)
    return running(rows, ["session_id"], STEP_ORDER, [Running("position", "count")], segment).select(*steps.columns, "position")


def write_steps(steps: DataFrame, path: str) -> None:
    """Steps as Parquet in total order: files follow each other by session and position, rows within them too (L3)."""
    key = ["session_id", "position"]
    ordered_steps(steps).repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def activity_counts(steps: DataFrame) -> DataFrame:
    """Steps per phase."""
    return steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("steps"),
        *[F.count_if(F.col("phase") == p).alias(p) for p in ("input", "process", "boundary", "outcome", "health")],
    )


def turn_order(steps: DataFrame) -> DataFrame:
    """Turns of a session numbered by first appearance (L4)."""
    first = steps.filter(F.length("request_id") > 0).groupBy("session_id", "request_id").agg(
        F.min(F.struct("seq", "wall_time")).alias("at")
    ).select("session_id", "request_id", "at.*")
    order = ["seq", "wall_time", "request_id"]
    first, segment = by_count(cut(first), ["session_id"], order)
    return running(first, ["session_id"], order, [Running("turn_no", "count")], segment).select("session_id", "request_id", "turn_no")
