"""Context events as generic trace rows, and the join back by event id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import DEFAULT, Names

SIDECAR = (
    "session_id", "request_id", "attempt_id", "evidence", "coverage", "boundary", "adapter_id", "source_key",
    "content_version_key", "parent_event_ids", "lineage_event_ids",
)


def parent_union() -> Column:
    """Parents then lineage, each once, in order."""
    return F.array_distinct(F.concat("parent_event_ids", "lineage_event_ids"))


def parent_relations() -> Column:
    """Relation per parent; a lineage entry overrides a direct one."""
    own = F.transform("parent_event_ids", lambda p, i: F.struct(
        p.alias("key"),
        F.when(F.col("observation") == "response", "response_to")
        .when(F.col("observation") == "inclusion", F.when(i == 0, "match_source").otherwise("match_request"))
        .otherwise("recorded_parent").alias("value"),
    ))
    lineage = F.transform("lineage_event_ids", lambda p: F.struct(
        p.alias("key"), F.lit("summary_ancestor").alias("value")
    ))
    # Map building keeps the last value of a repeated key (LAST_WIN).
    return F.map_from_entries(F.concat(own, lineage))


def usage_map() -> Column:
    """Only the counters that were recorded."""
    filled = F.create_map(
        F.lit("input"), F.col("usage_input_tokens"), F.lit("output"), F.col("usage_output_tokens"),
        F.lit("cached"), F.col("usage_cached_tokens"),
    )
    return F.map_filter(filled, lambda k, x: x.isNotNull())


def generic_rows(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """Content-free generic events with the provenance fields in a sidecar struct."""
    parents = parent_union()
    return events.select(
        F.col("event_id").alias("id"), F.get(parents, F.lit(0)).alias("parent_id"), parents.alias("parent_ids"),
        parent_relations().alias("parent_relations"),
        F.concat(F.lit(names.kind_prefix), "observation").alias("kind"), F.col("source_category").alias("role"),
        F.col("source_alias").alias("name"), F.col("wall_time").alias("timestamp"), F.lit("").alias("content"),
        ((F.col("observation") == "capture_health") & (F.coalesce("dropped_events", F.lit(0)) > 0)).alias("is_error"),
        usage_map().alias("usage"), F.struct("schema_version", *SIDECAR).alias("provenance"),
    )


def as_trace(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """The export as trace events, skipping the file hop between recorder and analyzer."""
    rows = generic_rows(events, names)
    return rows.select(
        F.col("provenance.session_id").alias("session_id"), "id", "parent_id", "kind", "role", "name",
        F.col("timestamp").alias("ts_raw"), F.lit("").alias("text"), F.lit("").alias("signature"), "is_error", "usage",
        "parent_ids", "parent_relations",
    ).join(events.select(F.col("event_id").alias("id"), F.col("producer_seq").alias("seq")), "id")


def join_last(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Analysis nodes with the last provenance row of the same id (J3, lenient)."""
    columns = ("session_id", "request_id", "observation", "evidence", "coverage", "boundary", "adapter_id")
    order = F.col("position") if "position" in events.columns else F.col("producer_seq")
    latest = events.groupBy("event_id").agg(F.max_by(F.struct(*columns), order).alias("e"))
    ids = nodes.filter(F.length("id") > 0).select(F.col("id").alias("event_id")).distinct()
    return latest.join(ids, "event_id", "left_semi").select("event_id", "e.*")


def join_unique(nodes: DataFrame, events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """Analysis nodes with their provenance row; repeated provenance ids are an error (J3, strict)."""
    once = events.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.struct("session_id", "request_id", "observation", "evidence", "coverage", "boundary")).alias("e"),
    )
    ids = nodes.select(F.col("id").alias("event_id")).distinct()
    checked = once.withColumn("ok", F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate event id"))).otherwise(True))
    return checked.filter("ok").join(ids, "event_id", "left_semi").select(
        "event_id", "e.session_id", "e.request_id", F.concat(F.lit(names.kind_prefix), "e.observation").alias("kind"),
        "e.evidence", "e.coverage", "e.boundary",
    )


def content_free(trace: DataFrame) -> DataFrame:
    """Trace rows without their text."""
    return trace.drop("text")


def safe_alias(alias: Column) -> Column:
    """Absolute POSIX, home or Windows paths shrink to their last part."""
    windows = alias.rlike(r"^[A-Za-z]:[\\/]")
    posix = alias.startswith("/") | alias.startswith("~/")
    trimmed = F.when(windows, F.regexp_replace(alias, r"[\\/]+$", "")).otherwise(F.regexp_replace(alias, "/+$", ""))
    return (
        F.when(windows, F.element_at(F.split(trimmed, r"[\\/]"), -1))
        .when(posix, F.element_at(F.split(trimmed, "/"), -1)).otherwise(alias)
    )


def safe_projection(events: DataFrame) -> DataFrame:
    """Columns fit for display: no raw text, no source path, no notes, short aliases."""
    return events.drop("notes").withColumns({
        "raw_text": F.lit(None).cast("string"), "source_path": F.lit(None).cast("string"),
        "raw_text_redacted": F.lit(True), "source_alias": safe_alias(F.col("source_alias")),
    })
