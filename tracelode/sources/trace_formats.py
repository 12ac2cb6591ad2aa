"""Raw log lines to ``trace_events`` (S4-S6), fail-closed per session.

``ingest`` returns events, sessions and errors. A session with any error keeps
only its error rows; nothing of it reaches the events.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions import variants as v
from ..names import DEFAULT, Names
from ..operators.ordered import Running, largest_group, running, seq_segment
from ..session import cut
from . import lines as ln

# Positions inside one line never reach this, so seq keeps (line, position) order without a shuffle.
POSITIONS = 1 << 20


@dataclass
class Ingested:
    events: DataFrame
    sessions: DataFrame
    errors: DataFrame


def by_source(found: Ingested) -> Ingested:
    """What was ingested with the file as the identity of a session.

    A format names a session by its header, file or folder, so files of one name, or copies of one log, bear one name.
    Here ``session_id`` is the source, and the name stays as ``session_name``; everything that groups, orders or joins
    by ``session_id`` then keeps the files apart.
    """
    own = lambda rows: rows.withColumns({"session_name": F.col("session_id"), "session_id": F.col("source")})
    return Ingested(own(found.events), own(found.sessions), found.errors)


def _get(path: str) -> Column:
    return v.at(F.col("value"), path)


def _has(key: str) -> Column:
    return F.array_contains(F.col("keys"), key)


def _opt(value: Column) -> Column:
    """Text of a value that is set, else null."""
    return F.when(v.truthy(value), v.text(value))


def _usage_bad(usage: Column) -> Column:
    return F.exists(F.map_values(usage), lambda x: ~v.finite(x))


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _no_usage() -> Column:
    return F.map_from_arrays(_no_ids(), F.array().cast("array<double>"))


def _absent(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _event_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "source", "session_id", "seq", "id", "parent_id", "kind", "role", "name", "ts_raw", "text", "signature",
        "is_error", "usage", "parent_ids", "parent_relations", "redactions", "meta", "format", "line_no", "reason",
    )


def pi_events(tagged: DataFrame) -> DataFrame:
    """Message log with tool calls inside assistant content."""
    rows = tagged.filter(F.col("ordinal") > 0)
    message = F.when(v.is_object(_get("$.message")), _get("$.message")).otherwise(F.parse_json(F.lit("{}")))
    entry = rows.select(
        "source", "line_no", "ordinal", "reason", "format", "value",
        F.coalesce("header_id", ln.stem(F.col("source"))).alias("session_id"),
        F.coalesce(_opt(_get("$.id")), F.concat(F.lit("entry-"), F.col("ordinal").cast("string"))).alias("entry_id"),
        v.text(F.when(~F.coalesce(v.kind_of(_get("$.parentId")) == "VOID", F.lit(True)), _get("$.parentId"))).alias("up"),
        F.coalesce(v.text(_get("$.type")), F.lit("event")).alias("type"),
        message.alias("m"),
    )
    m = lambda path: v.at(F.col("m"), path)
    role = F.coalesce(v.text(m("$.role")), F.lit("unknown"))
    tool_name = _opt(m("$.toolName"))
    is_message = F.col("type") == "message"
    body = F.when(role == "bashExecution", F.coalesce(v.text(m("$.output")), F.lit(""))).otherwise(
        v.content_text(m("$.content"))
    )
    stop = v.string(m("$.stopReason"))
    typed = entry.select(
        "*", role.alias("role_"), body.alias("body"),
        F.when(role.isin("toolResult", "bashExecution"), "tool_result").otherwise("message").alias("kind_"),
        F.when(role == "bashExecution", F.lit("bash")).otherwise(tool_name).alias("name_"),
        F.when(role == "toolResult", F.coalesce(_opt(m("$.toolCallId")), F.nullif(F.col("up"), F.lit(""))))
        .otherwise(F.col("up")).alias("parent_"),
        (v.truthy(m("$.isError")) | F.coalesce(stop.isin("error", "aborted"), F.lit(False))).alias("error_"),
        v.numeric_map(m("$.usage")).alias("usage_"),
        F.coalesce(_opt(v.at(F.col("value"), "$.timestamp")), _opt(m("$.timestamp"))).alias("ts_"),
        F.to_json(F.struct(stop.alias("stop_reason")), {"ignoreNullFields": "false"}).alias("meta_"),
        _opt(v.at(F.col("value"), "$.modelId")).alias("model"),
    )
    calls = F.filter(
        F.transform(
            F.coalesce(v.items(m("$.content")), F.array().cast("array<variant>")),
            lambda item, i: F.struct(i.alias("i"), item.alias("item")),
        ),
        lambda r: v.is_object(r["item"]) & F.coalesce(v.string(v.at(r["item"], "$.type")) == "toolCall", F.lit(False)),
    )
    none = F.lit(None).cast("int")
    slots = F.concat(
        F.array(F.struct(none.alias("i"), F.lit(None).cast("variant").alias("item"))),
        F.when(is_message, calls).otherwise(F.array().cast("array<struct<i:int,item:variant>>")),
    )
    fanned = typed.select("*", F.posexplode(slots).alias("pos", "slot")).withColumn("call", F.col("pos") > 0)
    item = F.col("slot.item")
    args = F.coalesce(v.at(item, "$.arguments"), F.parse_json(F.lit("{}")))
    cleaned = fanned.withColumn("args", v.nested_clean(F.when(F.col("call"), F.to_json(args))))
    plain_text = tx.redacted(F.col("body"))
    call, msg = F.col("call"), is_message
    return _event_columns(cleaned.select(
        "source", "line_no", "session_id", "format",
        (F.col("ordinal") * POSITIONS + F.col("pos")).alias("seq"),
        F.when(call, F.coalesce(
            _opt(v.at(item, "$.id")), F.concat_ws("-", "entry_id", F.lit("tool"), F.col("slot.i").cast("string"))
        )).otherwise(F.col("entry_id")).alias("id"),
        F.when(call, F.col("entry_id")).when(msg, F.col("parent_")).otherwise(F.col("up")).alias("parent_id"),
        F.when(call, "tool_call").when(msg, F.col("kind_")).otherwise(F.col("type")).alias("kind"),
        F.when(call, "assistant").when(msg, F.col("role_")).alias("role"),
        F.when(call, F.coalesce(v.text(v.at(item, "$.name")), F.lit("unknown"))).when(msg, F.col("name_")).alias("name"),
        F.when(msg, F.col("ts_")).otherwise(_opt(v.at(F.col("value"), "$.timestamp"))).alias("ts_raw"),
        F.when(call, F.col("args.value")).when(msg, plain_text).otherwise(F.lit("")).alias("text"),
        F.when(call, tx.digest16(F.lit("tool_call"), tx.canonical(v.text(v.at(item, "$.name"))), F.col("args.canonical")))
        .when(msg, tx.fingerprint(F.col("kind_"), F.col("role_"), F.col("name_"), F.col("body")))
        .otherwise(tx.fingerprint(F.col("type"), F.col("model"))).alias("signature"),
        F.when(call | ~msg, F.lit(False)).otherwise(F.col("error_")).alias("is_error"),
        F.when(call | ~msg, _no_usage()).otherwise(F.col("usage_")).alias("usage"),
        _absent("array<string>").alias("parent_ids"), _absent("map<string,string>").alias("parent_relations"),
        F.when(call, F.col("args.labels")).when(msg, tx.redaction_labels(F.col("body"))).otherwise(_no_ids()).alias("redactions"),
        F.when(msg & ~call, F.col("meta_")).alias("meta"),
        F.coalesce("reason", F.when(msg & ~call & _usage_bad(F.col("usage_")), F.lit("usage_not_finite"))).alias("reason"),
    ))


def generic_events(tagged: DataFrame, biggest: int | None = None) -> DataFrame:
    """One object per event; an omitted parent means the previous event."""
    rows = tagged.withColumn("keys", F.json_object_keys(F.to_json("value")))
    pids, pid, rel = _get("$.parent_ids"), _get("$.parent_id"), _get("$.parent_relations")
    body = F.when(_has("content"), v.content_text(_get("$.content"))).otherwise(v.content_text(_get("$.text")))
    ids = F.transform(v.items(pids), lambda p: v.string(p))
    typed = rows.select(
        "source", "line_no", "ordinal", "reason", "format", "keys",
        ln.stem(F.col("source")).alias("session_id"),
        F.coalesce(_opt(_get("$.id")), F.concat(F.lit("event-"), (F.col("ordinal") + 1).cast("string"))).alias("id"),
        F.coalesce(_opt(_get("$.kind")), _opt(_get("$.type")), F.lit("message")).alias("kind"),
        _opt(_get("$.role")).alias("role"),
        F.coalesce(_opt(_get("$.name")), _opt(_get("$.tool")), _opt(_get("$.tool_name"))).alias("name"),
        v.text(_get("$.timestamp")).alias("ts_raw"),
        body.alias("body"),
        (v.truthy(_get("$.is_error")) | v.truthy(_get("$.error"))).alias("is_error"),
        v.numeric_map(_get("$.usage")).alias("usage"),
        F.when(_has("parent_ids"), ids).alias("listed"),
        v.is_array(pids).alias("ids_ok"),
        F.when(~F.coalesce(v.kind_of(pid) == "VOID", F.lit(True)), v.text(pid)).alias("one"),
        v.is_object(rel).alias("rel_ok"),
        F.transform_values(v.string_map(rel), lambda k, x: v.string(x)).alias("relations"),
        F.when(_has("arguments"), F.to_json(_get("$.arguments"))).alias("arguments"),
    )
    linked = running(
        typed, ["source"], ["ordinal"], [Running("previous", "last", F.col("id"), include_current=False)],
        seq_segment("ordinal", biggest),
    )
    listed = F.col("listed")
    parent = (
        F.when(_has("parent_ids"), F.get(listed, F.lit(0)))
        .when(_has("parent_id"), F.col("one")).otherwise(F.col("previous"))
    )
    placed = linked.withColumn("parent_id", parent).withColumn("args", v.nested_clean(F.col("arguments")))
    declared = F.when(_has("parent_ids"), listed).when(
        F.length("parent_id") > 0, F.array("parent_id")
    ).otherwise(_no_ids())
    bad_ids = _has("parent_ids") & (
        ~F.col("ids_ok") | F.exists(listed, lambda p: p.isNull() | (p == "")) | (F.size(F.array_distinct(listed)) != F.size(listed))
    )
    mismatch = _has("parent_ids") & F.col("one").isNotNull() & ~F.col("one").eqNullSafe(F.get(listed, F.lit(0)))
    bad_relations = _has("parent_relations") & (
        ~F.col("rel_ok")
        | F.exists(F.map_keys("relations"), lambda k: ~F.array_contains(declared, k))
        | F.exists(F.map_values("relations"), lambda x: x.isNull() | (F.trim(x) == "") | (F.length(x) > fv.MAX_RELATION_CHARS))
    )
    reason = F.coalesce(
        F.col("reason"),
        F.when(bad_ids, "malformed_parent_ids").when(mismatch, "parent_mismatch")
        .when(bad_relations, "malformed_parent_relations").when(_usage_bad(F.col("usage")), "usage_not_finite"),
    )
    argument = F.when(F.col("arguments").isNotNull(), F.col("args.canonical")).otherwise(tx.canonical(F.col("body")))
    return _event_columns(placed.select(
        "source", "line_no", "session_id", F.col("ordinal").alias("seq"), "id", "parent_id", "kind", "role", "name",
        "ts_raw", tx.redacted(F.col("body")).alias("text"),
        tx.digest16(*[tx.canonical(F.col(c)) for c in ("kind", "role", "name")], argument).alias("signature"),
        "is_error", "usage", F.when(_has("parent_ids"), listed).alias("parent_ids"),
        F.when(F.size("relations") > 0, F.col("relations")).alias("parent_relations"),
        tx.redaction_labels(F.col("body")).alias("redactions"), F.lit(None).cast("string").alias("meta"), "format",
        reason.alias("reason"),
    ))


def loop_events(tagged: DataFrame, names: Names = DEFAULT, biggest: int | None = None) -> DataFrame:
    """Improvement-loop log: a linear chain of stage records with allow-listed metadata."""
    event, iteration = v.string(_get("$.event")), _get("$.iteration")
    step = F.when(v.is_integer(iteration), v.at(iteration, "$", "bigint"))
    kept = F.map_filter(v.string_map(F.col("value")), lambda k, x: k.isin(*fv.LOOP_METADATA, "event", "iteration"))
    status = v.string(_get("$.status"))
    not_ok = F.coalesce(v.is_bool(_get("$.ok")) & (F.to_json(_get("$.ok")) == "false"), F.lit(False))
    adapter = v.string(_get("$.adapter"))
    typed = tagged.select(
        "source", "line_no", "ordinal", "format",
        F.coalesce(F.nullif(ln.folder(F.col("source")), F.lit("")), ln.stem(F.col("source"))).alias("session_id"),
        event.alias("event"), step.alias("iteration"), adapter.alias("adapter"), status.alias("status"),
        F.format_string("iteration-%03d-%s-%04d", step, event, F.col("ordinal") + 1).alias("id"),
        F.coalesce(
            F.col("reason"),
            F.when(~F.coalesce(event.isin(*fv.LOOP_EVENTS), F.lit(False)) | step.isNull(), "malformed_loop_event")
            .when(step < 0, "negative_iteration"),
        ).alias("reason"),
        F.coalesce(
            (event.isin("generate", "evaluate") & not_ok)
            | ((event == "finish") & F.coalesce(status.isin("failed", "stopped"), F.lit(False))), F.lit(False),
        ).alias("is_error"),
        v.text(_get("$.ts")).alias("ts_raw"),
        tx.fingerprint(
            F.lit(names.loop_signature), event, adapter, v.text(_get("$.action")), status, v.text(_get("$.failureClass"))
        ).alias("signature"),
        F.to_json(kept).alias("kept"),
    )
    # Metadata is flat as a rule: only what is nested or may hold something to redact goes to the helper.
    plain = v.needs_no_cleaning(F.col("kept"))
    deep = typed.filter(~plain).withColumn("clean", v.nested_clean(F.col("kept")))
    cleaned = typed.filter(plain).withColumns({"meta": F.col("kept"), "redactions": _no_ids()}).unionByName(
        deep.withColumns({"meta": F.to_json(F.parse_json("clean.value")), "redactions": F.col("clean.labels")}).drop("clean"))
    linked = running(
        cleaned, ["source"], ["ordinal"], [Running("parent_id", "last", F.col("id"), include_current=False)],
        seq_segment("ordinal", biggest),
    )
    return _event_columns(linked.select(
        "source", "line_no", "session_id", F.col("ordinal").alias("seq"), "id", "parent_id",
        F.concat(F.lit("loop_"), "event").alias("kind"), F.lit("controller").alias("role"),
        F.coalesce("adapter", "event").alias("name"), "ts_raw", F.lit("").alias("text"), "signature", "is_error",
        _no_usage().alias("usage"),
        _absent("array<string>").alias("parent_ids"), _absent("map<string,string>").alias("parent_relations"),
        "redactions", "meta", "format", "reason",
    ))


def loop_sessions(events: DataFrame) -> DataFrame:
    """Session row of a loop trace: highest iteration, last finish status; adapters in ``loop_adapters``."""
    meta = F.parse_json("meta")
    status = F.when(F.col("kind") == "loop_finish", v.string(v.at(meta, "$.status")))
    return events.groupBy("session_id").agg(
        F.max(v.at(meta, "$.iteration", "bigint")).alias("iterations"),
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
    )


def loop_adapters(events: DataFrame) -> DataFrame:
    """Distinct adapters per loop session."""
    adapter = v.string(v.at(F.parse_json("meta"), "$.adapter"))
    return events.select("session_id", adapter.alias("adapter")).filter(F.col("adapter").isNotNull()).distinct()


def _session_rows(tagged: DataFrame, names: Names) -> DataFrame:
    cwd = _get("$.cwd")  # a session's first line is its header
    pi = F.col("format") == names.pi_format
    loop = F.col("format") == names.loop_format
    first = tagged.filter("ordinal = 0")
    return first.select(
        F.when(pi, F.coalesce("header_id", ln.stem(F.col("source"))))
        .when(loop, F.coalesce(F.nullif(ln.folder(F.col("source")), F.lit("")), ln.stem(F.col("source"))))
        .otherwise(ln.stem(F.col("source"))).alias("session_id"),
        "source", "format",
        F.when(pi & v.truthy(cwd), tx.fingerprint(F.lit("cwd"), v.text(cwd))).alias("cwd_fingerprint"),
        F.when(pi, v.text(_get("$.version"))).alias("version"),
    )


def ingest(
    lines: DataFrame, scan_errors: DataFrame | None = None, names: Names = DEFAULT, biggest: int | None = None
) -> Ingested:
    """All formats at once: detect, normalise, validate, quarantine whole sessions."""
    # Bronze table: lines are parsed once; the formats and the error report read from it.
    tagged = cut(ln.with_format(ln.parse(lines), names))
    usable = tagged.filter(F.col("reason").isNull() & F.col("format").isNotNull())
    # Measured here where the caller has not: small sessions need no segments, and their lines are read once.
    biggest = largest_group(tagged, "source") if biggest is None else biggest
    readers = {
        names.pi_format: pi_events,
        names.generic_format: lambda rows: generic_events(rows, biggest),
        names.loop_format: lambda rows: loop_events(rows, names, biggest),
    }
    found = [r["format"] for r in usable.select("format").distinct().collect()] or [names.generic_format]
    staged = [readers[f](usable.filter(F.col("format") == f)) for f in found]
    return settle(cut(reduce(lambda a, b: a.unionByName(b), staged)), tagged, _session_rows(tagged, names), scan_errors)


def settle(staged: DataFrame, parsed: DataFrame, sessions: DataFrame, scan_errors: DataFrame | None = None) -> Ingested:
    """Split staged events into clean sessions and quarantine."""
    null_line = F.lit(None).cast("bigint").alias("line_no")
    counts = staged.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.filter("n > 1").select("source", null_line, F.lit("duplicate_event_id").alias("reason")).distinct()
    errors = (
        parsed.filter(F.col("reason").isNotNull()).select("source", "line_no", "reason")
        .unionByName(staged.filter(F.col("reason").isNotNull()).select("source", "line_no", "reason"))
        .unionByName(repeated)
    )
    if scan_errors is not None:
        errors = errors.unionByName(scan_errors)
    bad = errors.select("source").distinct()
    events = staged.join(bad, "source", "left_anti").drop("line_no", "reason")
    return Ingested(events, sessions.join(bad, "source", "left_anti"), errors)
