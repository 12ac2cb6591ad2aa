"""Agent-host records to context events.

Raw tables hold one JSON record per row with its session and position; every
adapter is one projection over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions import variants as v
from ..names import DEFAULT, Names
from ..operators.ordered import Running, running, seq_segment, with_halo
from .context import build


def _get(path: str) -> Column:
    return v.at(F.col("value"), path)


def _id(session: Column, position: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", session, position.cast("string")), 256), 1, 32)


def _case(kind: Column, per_kind: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """Merge per-kind column sets into one CASE per column."""
    merged: dict[str, Column] = {}
    for name in dict.fromkeys(c for columns in per_kind.values() for c in columns):
        case = None
        for value, columns in per_kind.items():
            if name in columns:
                case = F.when(kind == value, columns[name]) if case is None else case.when(kind == value, columns[name])
        merged[name] = case
    return merged


def _fixed(**values: str) -> dict[str, Column]:
    return {k: F.lit(x) for k, x in values.items()}


def _sized(text: Column, chars: bool = True) -> dict[str, Column]:
    """Version, estimate and sizes of a text; all null when it is empty."""
    return _full(F.when(F.length(text) > 0, text), chars)


def _full(text: Column, chars: bool = True) -> dict[str, Column]:
    """Version, estimate and sizes of a text, also when it is empty."""
    return {"_version_of": text, "_size_of": text} | ({"_chars_of": text} if chars else {})


def _key(kind: str, material: Column) -> dict[str, Column]:
    return {"_key_of": F.concat(F.lit(f"{kind}:"), material)}


def _finish(df: DataFrame, columns: dict[str, Column], secret: str, names: Names) -> DataFrame:
    """Turn the inputs that the cases chose into keys, versions and sizes, each computed once per row."""
    inputs = {c: x for c, x in columns.items() if c.startswith("_")}
    out = {c: x for c, x in columns.items() if not c.startswith("_")}
    made = {
        "source_key": lambda: tx.hmac32(F.col("_key_of"), secret) if "_key_of" in inputs else None,
        "content_version_key": lambda: tx.content_version(F.col("_version_of"), secret) if "_version_of" in inputs else None,
        "estimated_tokens": lambda: tx.token_estimate(F.col("_size_of")) if "_size_of" in inputs else None,
        "byte_count": lambda: tx.byte_size(F.col("_size_of")) if "_size_of" in inputs else None,
        "char_count": lambda: tx.utf16_length(F.col("_chars_of")) if "_chars_of" in inputs else None,
    }
    guard = {"source_key": "_key_of", "content_version_key": "_version_of", "estimated_tokens": "_size_of",
             "byte_count": "_size_of", "char_count": "_chars_of"}
    for name, make in made.items():
        value = make()
        if value is not None:
            value = F.when(F.col(guard[name]).isNotNull(), value)
            out[name] = F.coalesce(out[name], value) if name in out else value
    return build(df.withColumns(inputs), out, names)


# --- rollout transcripts ----------------------------------------------------


def codex_rollout(lines: DataFrame, secret: str, names: Names = DEFAULT, biggest: int | None = None) -> DataFrame:
    """Rollout transcript lines (session_id, ordinal, line) to context events.

    One ordered scan yields the turn number, the latest user message of the
    turn, the producer sequence and the cumulative drop count.
    """
    parsed = lines.withColumn("value", F.try_parse_json("line"))
    role = v.string(_get("$.payload.role"))
    content = _get("$.payload.content")
    objects = F.filter(v.items(content), v.is_object)
    said = F.transform(objects, lambda p: F.coalesce(v.string(v.at(p, "$.text")), v.string(v.at(p, "$.input_text"))))
    user_text = F.coalesce(v.string(content), F.array_join(said, "\n"), F.lit(""))
    answer_text = v.content_text(
        content,
        lambda p: F.coalesce(v.string(v.at(p, "$.type")).isin("output_text", "text"), F.lit(False)) & v.is_string(v.at(p, "$.text")),
    )
    kind, inner = v.string(_get("$.type")), v.string(_get("$.payload.type"))
    typed = parsed.select(
        "session_id", "ordinal", "value",
        F.coalesce((kind == "turn_context") | F.coalesce(inner == "task_started", F.lit(False)), F.lit(False)).alias("starts"),
        F.when(F.coalesce(role == "user", F.lit(False)), user_text).otherwise("").alias("user_text"),
        F.when(F.coalesce(role == "assistant", F.lit(False)), answer_text).otherwise("").alias("answer_text"),
        kind.alias("line_type"), inner.alias("inner_type"), _id(F.col("session_id"), F.col("ordinal")).alias("event_id"),
    ).withColumn(
        "shape",
        F.when(F.col("value").isNull(), "drop")
        .when(F.col("line_type") == "session_meta", "meta")
        .when((F.col("line_type") == "response_item") & (F.col("user_text") != ""), "user")
        .when((F.col("line_type") == "response_item") & (F.col("answer_text") != ""), "answer")
        .when((F.col("line_type") == "event_msg") & (F.col("inner_type") == "token_count"), "usage"),
    )
    # A turn start clears the latest user message: the empty marker wins until the next user line.
    speaker = F.when(F.col("shape") == "user", F.col("event_id")).when(F.col("starts"), F.lit(""))
    scanned = running(
        typed, ["session_id"], ["ordinal"],
        [
            Running("turn", "sum", F.col("starts").cast("int")),
            Running("speaker", "last", speaker),
            Running("producer_seq", "sum", F.col("shape").isNotNull().cast("int")),
            Running("dropped", "sum", F.coalesce(F.col("shape") == "drop", F.lit(False)).cast("int")),
        ],
        seq_segment("ordinal", biggest),
    ).filter(F.col("shape").isNotNull())
    request = F.concat_ws(
        ":", F.lit("codex"), "session_id", F.concat(F.lit("t"), F.greatest("turn", F.lit(1)).cast("string"))
    )
    said_text = F.when(F.col("shape") == "user", F.col("user_text")).otherwise(F.col("answer_text"))
    phase = F.coalesce(v.string(_get("$.payload.phase")), F.lit("unknown"))
    hidden = tx.looks_secret(said_text)
    totals = F.coalesce(
        F.when(v.is_object(_get("$.payload.info.total_token_usage")), _get("$.payload.info.total_token_usage")),
        _get("$.payload.info.last_token_usage"),
    )
    count = lambda key: v.number(v.at(totals, f"$.{key}"))
    item = lambda other: F.coalesce(v.text(_get("$.payload.id")), other)
    sized = _sized(said_text)
    per_shape = {
        "meta": _fixed(
            observation="inventory", evidence="inventoried", boundary="transcript.session_meta", coverage="partial",
            source_category="other", source_alias="codex_session",
        ) | {
            **_key("session", F.coalesce(
                v.text(_get("$.payload.session_id")), v.text(_get("$.payload.id")), F.col("session_id"))),
            "notes": F.format_string(
                "cli_version=%s; model_provider=%s",
                F.coalesce(v.text(_get("$.payload.cli_version")), F.lit("unknown")),
                F.coalesce(v.text(_get("$.payload.model_provider")), F.lit("unknown"))),
            "raw_text_redacted": F.lit(True),
        },
        "user": _fixed(
            observation="load", evidence="runtime_loaded", boundary="transcript.user_message", coverage="partial",
            source_category="user_input", source_alias="user_prompt", encoding="utf8",
        ) | sized | {
            **_key("user_input", item(request)), "raw_text_redacted": F.lit(True),
            "notes": F.when(hidden, "secret-like user text redacted; metadata only"),
        },
        "answer": _fixed(
            observation="response", evidence="runtime_loaded", boundary="transcript.assistant_message",
            coverage="partial", source_category="model_output", encoding="utf8",
        ) | sized | {
            "source_alias": F.concat(F.lit("codex_assistant_"), phase),
            **_key("model_output", item(F.concat_ws(":", request, phase))),
            "parent_event_ids": F.when(F.length("speaker") > 0, F.array("speaker")),
            "raw_text_redacted": F.lit(True),
            "notes": F.when(hidden, "secret-like assistant text redacted; metadata only"),
        },
        "usage": _fixed(observation="usage", evidence="final_dispatch", boundary="transcript.token_count") | {
            "coverage": F.when(count("input_tokens").isNull() & count("output_tokens").isNull(), "partial").otherwise("full"),
            "usage_input_tokens": count("input_tokens"), "usage_output_tokens": count("output_tokens"),
            "usage_cached_tokens": count("cached_input_tokens"),
        },
        "drop": _fixed(
            observation="capture_health", evidence="unknown", boundary="transcript.parse_error", coverage="partial",
        ) | {
            "dropped_events": F.col("dropped"),
            "notes": F.format_string("dropped 1 event(s); cumulative=%d", "dropped"),
        },
    }
    columns = _case(F.col("shape"), per_shape)
    columns["parent_event_ids"] = F.coalesce(columns["parent_event_ids"], F.array().cast("array<string>"))
    known = F.col("shape") != "drop"
    return _finish(scanned, columns | {
        "event_id": F.col("event_id"), "session_id": F.col("session_id"), "producer_seq": F.col("producer_seq"),
        "request_id": F.when(known, request), "attempt_id": F.when(known, F.concat(request, F.lit(":a1"))),
        "wall_time": v.string(_get("$.timestamp")),
        "adapter_id": F.lit(fv.CODEX_ADAPTER), "adapter_version": F.lit(fv.CODEX_VERSION),
    }, secret, names)


def codex_history(rows: DataFrame, secret: str, names: Names = DEFAULT) -> DataFrame:
    """Prompt history (session_id, seq, ts, text) to inventory rows."""
    some = rows.filter(F.length("text") > 0)
    request = F.concat_ws(":", F.lit("codex-hist"), "session_id", F.coalesce(F.col("ts").cast("string"), F.lit("0")))
    hidden = tx.looks_secret(F.col("text"))
    return _finish(some, _fixed(
        observation="inventory", evidence="inventoried", boundary="history.user_text", coverage="partial",
        source_category="user_input", source_alias="history_prompt",
        adapter_id=fv.CODEX_ADAPTER, adapter_version=fv.CODEX_VERSION,
    ) | {
        "session_id": F.col("session_id"), "producer_seq": F.col("seq"), "wall_time": F.col("ts").cast("string"),
        "request_id": request, "attempt_id": F.concat(request, F.lit(":a1")),
        **_key("user_input", request),
        "content_version_key": tx.content_version(F.col("text"), secret),
        "estimated_tokens": tx.token_estimate(F.col("text")), "raw_text_redacted": F.lit(True),
        "notes": F.when(hidden, "secret-like history text redacted"),
    }, secret, names)


# --- hook records -----------------------------------------------------------


def claude_hooks(records: DataFrame, secret: str, names: Names = DEFAULT) -> DataFrame:
    """Hook records (session_id, seq, wall_time, body) to context events."""
    rows = records.withColumn("value", F.try_parse_json("body"))
    boundary = F.coalesce(
        v.text(_get("$.hook_event_name")), v.text(_get("$.hookEventName")), F.lit("unknown")
    )
    shape = (
        F.when(boundary.isin(*fv.CLAUDE_UNSUPPORTED), "unsupported")
        .when(boundary.isin("SessionStart", "UserPromptSubmit", "PreToolUse", "PostToolUse", "PreCompact"), boundary)
        .otherwise("unlisted")
    )
    given = v.text(_get("$.request_id"))
    request = F.coalesce(given, F.concat_ws(
        ":", F.lit("claude"), F.coalesce(v.text(_get("$.session_id")), F.lit("nosession")), boundary,
        F.col("seq").cast("string"),
    ))
    typed = rows.select("*", boundary.alias("boundary"), shape.alias("shape"), request.alias("request"))
    prompt = F.coalesce(v.text(_get("$.prompt")), F.lit(""))
    tool = F.coalesce(v.text(_get("$.tool_name")), F.lit("unknown"))
    answer = F.coalesce(
        v.string(_get("$.tool_response")),
        F.when(F.coalesce(v.kind_of(_get("$.tool_response")) != "VOID", F.lit(False)),
               F.get_json_object("body", "$.tool_response")),
        F.lit(""),
    )
    req = F.col("request")
    hidden = F.lit(True)
    per_shape = {
        "unsupported": _fixed(observation="capture_health", evidence="unknown", coverage="unsupported") | {
            "unsupported_boundary": F.col("boundary"),
        },
        "SessionStart": _fixed(
            observation="inventory", evidence="inventoried", coverage="partial", source_category="other",
            source_alias="claude_session",
        ) | {
            **_key("session", F.coalesce(v.text(_get("$.session_id")), F.lit("unknown"))),
            "raw_text_redacted": hidden,
        },
        "UserPromptSubmit": _fixed(
            observation="load", evidence="runtime_loaded", coverage="partial", source_category="user_input",
            source_alias="user_prompt", encoding="utf8",
        ) | _sized(prompt) | {
            **_key("user_input", req), "raw_text_redacted": hidden,
            "notes": F.when(tx.looks_secret(prompt), "secret-like prompt redacted; metadata only"),
        },
        "PreToolUse": _fixed(
            observation="load", evidence="runtime_loaded", coverage="partial", source_category="other",
        ) | {
            "source_alias": tool, **_key("tool_call", F.concat_ws(":", tool, req)),
            "raw_text_redacted": hidden,
        },
        "PostToolUse": _fixed(
            observation="read", evidence="read_result", source_category="tool_result", encoding="utf8",
        ) | _sized(answer, chars=False) | {
            "coverage": F.when(answer != "", "partial").otherwise("unknown"),
            "source_alias": tool, **_key("tool_result", F.concat_ws(":", tool, req)),
            "source_range": F.when(answer != "", F.struct(
                F.lit(0).cast("bigint").alias("start"), tx.byte_size(answer).alias("end"))),
            "raw_text_redacted": hidden,
        },
        "PreCompact": _fixed(
            observation="transform", evidence="summary_ancestor", coverage="partial", source_category="summary",
            source_alias="precompact",
        ) | {
            **_key("summary", req), "raw_text_redacted": hidden,
            "notes": F.concat(F.lit("PreCompact trigger="), F.coalesce(v.text(_get("$.compact_trigger")), F.lit("unknown"))),
        },
        "unlisted": _fixed(observation="capture_health", evidence="unknown", coverage="unknown") | {
            "unsupported_boundary": F.col("boundary"),
        },
    }
    return _finish(typed, _case(F.col("shape"), per_shape) | {
        "session_id": F.col("session_id"), "producer_seq": F.col("seq"), "wall_time": F.col("wall_time"),
        "boundary": F.col("boundary"), "request_id": req, "attempt_id": F.concat(req, F.lit(":a1")),
        "handler_ordinal": F.lit(0),
        "adapter_id": F.lit(fv.CLAUDE_ADAPTER), "adapter_version": F.lit(fv.CLAUDE_VERSION),
    }, secret, names)


# --- host events ------------------------------------------------------------


def tool_span(tool: Column, args: Column) -> dict[str, Column]:
    """Path, line range, observation and coverage of a tool call; never invents a range."""
    name = F.lower(F.coalesce(tool, F.lit("")))
    field = lambda key: v.string(v.at(args, f"$.{key}"))
    path = F.coalesce(field("path"), field("file_path"), field("filePath"))
    offset = v.number(v.at(args, "$.offset")).cast("bigint")
    limit = v.number(v.at(args, "$.limit")).cast("bigint")
    reads, edits = name.isin("read", "read_file"), name.isin("edit", "write", "apply_patch", "strreplace")
    finds = name.isin("grep", "find", "ls", "glob")
    ranged = F.coalesce(reads & offset.isNotNull() & (limit > 0), F.lit(False))
    pattern = F.coalesce(field("pattern"), field("glob_pattern"))
    return {
        "path": F.coalesce(path, F.when(finds & (pattern != ""), F.concat(F.lit("pattern:"), pattern))),
        "range": F.when(ranged, F.struct(offset.alias("start"), (offset + limit - 1).alias("end"))),
        "match_method": F.when(ranged, "runtime_line_range"),
        "observation": F.when(reads | finds, "read").when(edits, "transform").otherwise("load"),
        "coverage": F.when(ranged & path.isNotNull(), "full").otherwise("partial"),
    }


def pi_host_events(records: DataFrame, secret: str, names: Names = DEFAULT) -> DataFrame:
    """Host records (session_id, seq, wall_time, request_id, attempt_id, type, body) to context events.

    type: prompt, system_prompt, context_file, skill, tool_call, tool_result, payload, usage, compaction,
    extension, response, gap. ``body`` is the record's JSON.
    """
    rows = records.withColumn("value", F.try_parse_json("body"))
    req = F.col("request_id")
    text = lambda key: F.coalesce(v.string(_get(f"$.{key}")), F.lit(""))
    maybe = lambda key: v.string(_get(f"$.{key}"))
    flag = lambda key: F.coalesce(F.to_json(_get(f"$.{key}")) == "true", F.lit(False))
    load = _fixed(observation="load", evidence="runtime_loaded")
    body, redacted = text("text"), F.lit(True)
    tool, call = text("toolName"), F.coalesce(maybe("toolCallId"), F.lit("unknown"))
    span = tool_span(tool, _get("$.input"))
    is_text = v.is_string(_get("$.payload"))
    serial = F.when(is_text, maybe("payload")).otherwise(F.to_json(_get("$.payload")))
    final = flag("final")
    provisional = flag("provisional") & ~final
    number = lambda key: v.number(_get(f"$.{key}"))
    content = text("content")
    of_content = _sized(content)
    # A prompt, a tool result and a payload carry sizes even when they are empty.
    result_range = F.when(
        v.is_object(_get("$.range")),
        F.struct(v.at(_get("$.range.start"), "$", "bigint").alias("start"), v.at(_get("$.range.end"), "$", "bigint").alias("end")),
    ).when(F.coalesce(v.kind_of(_get("$.range")) == "VOID", F.lit(False)), None).otherwise(span["range"])
    result_path = F.coalesce(maybe("path"), span["path"])
    result_method = F.coalesce(maybe("matchMethod"), span["match_method"])
    plain = _full(serial, chars=False)
    per_type = {
        "prompt": load | _full(body) | _fixed(
            boundary="before_agent_start.prompt", coverage="full", source_category="user_input",
            source_alias="user_prompt", encoding="utf8",
        ) | {
            **_key("user_input", req), "raw_text_redacted": redacted,
            "notes": F.when(tx.looks_secret(body), "secret-like prompt redacted; metadata only"),
        },
        "system_prompt": load | _fixed(
            boundary="before_agent_start.systemPrompt", coverage="full", source_category="system_input",
            source_alias="Assembled system prompt", source_key="assembled-system-prompt",
        ) | {"_version_of": body, "raw_text_redacted": redacted},
        "context_file": load | of_content | _fixed(
            boundary="before_agent_start.contextFiles", source_category="instructions", encoding="utf8",
        ) | {
            "coverage": F.when(content != "", "full").otherwise("partial"), "source_alias": maybe("path"),
            "source_path": maybe("path"), **_key("instructions", maybe("path")),
            "raw_text_redacted": redacted,
        },
        "skill": load | of_content | _fixed(
            boundary="before_agent_start.skills", source_category="skill", encoding="utf8",
        ) | {
            "coverage": F.when(content != "", "full").otherwise("partial"), "source_alias": maybe("name"),
            "source_path": maybe("filePath"), **_key("skill", maybe("name")),
            "notes": F.when(maybe("filePath") != "", F.concat(F.lit("sourcePath="), maybe("filePath"))),
            "raw_text_redacted": redacted,
        },
        "tool_call": load | _fixed(boundary="tool_call.start", source_category="tool_result") | {
            "tool_call_id": call, "coverage": span["coverage"], "source_alias": F.coalesce(span["path"], tool),
            **_key("tool_call", F.concat_ws(":", tool, call)),
            "source_range": span["range"], "match_method": span["match_method"], "raw_text_redacted": redacted,
        },
        "tool_result": _full(content) | _fixed(
            evidence="read_result", boundary="tool_result", source_category="tool_result", encoding="utf8",
        ) | {
            "tool_call_id": call, "observation": F.coalesce(maybe("observation"), span["observation"]),
            "coverage": F.coalesce(maybe("coverage"), F.when(
                result_range.isNotNull() | (result_path != ""), span["coverage"]).otherwise("partial")),
            "source_alias": F.coalesce(result_path, tool),
            **_key("tool_result", F.concat_ws(":", tool, call)),
            "source_range": result_range, "match_method": result_method, "raw_text_redacted": redacted,
            "notes": F.when(tx.looks_secret(content), "secret-like tool output not persisted").when(
                result_range.isNull(), "No runtime span on tool result; refusing to invent 0..N byte range"),
        },
        "payload": plain | _fixed(source_category="unattributed", source_alias="provider_payload", encoding="json") | {
            "observation": F.when(final, "dispatch").otherwise("payload"),
            "evidence": F.when(final, "final_dispatch").otherwise("payload_snapshot"),
            "boundary": F.when(provisional, "before_provider_request.provisional").when(
                final, "before_provider_request.final").otherwise("before_provider_request"),
            "coverage": F.when(provisional, "partial").otherwise("full"),
            **_key("payload", req),
            "match_method": F.concat(F.lit("sha256:"), F.substring(F.sha2(serial, 256), 1, 16)),
            "raw_text_redacted": redacted,
        },
        "usage": _fixed(observation="usage", evidence="final_dispatch", boundary="provider_usage") | {
            "coverage": F.when(number("input").isNull(), "partial").otherwise("full"),
            "usage_input_tokens": number("input"), "usage_output_tokens": number("output"),
            "usage_cached_tokens": F.coalesce(number("cached"), number("cacheRead")),
        },
        "compaction": _fixed(
            observation="transform", evidence="summary_ancestor", boundary="compaction", coverage="full",
            source_category="summary", source_alias="compaction_summary",
        ) | {
            **_key("summary", req), "_version_of": body,
            "estimated_tokens": tx.token_estimate(body), "raw_text_redacted": redacted,
            "lineage_event_ids": F.transform(v.items(_get("$.ancestorEventIds")), lambda a: v.text(a)),
        },
        "extension": load | _fixed(
            boundary="extension_execute", coverage="full", source_category="other",
            ambiguity="extension executed; no payload match for extension source",
        ) | {"source_alias": maybe("name"), **_key("extension", maybe("name"))},
        "response": _fixed(
            observation="response", evidence="runtime_loaded", coverage="partial", boundary="message_end.assistant",
            source_category="model_output", source_alias="Assistant response",
        ) | {
            "_version_of": body, "byte_count": tx.byte_size(body),
            "parent_event_ids": F.when(maybe("payloadEventId") != "", F.array(maybe("payloadEventId"))),
            "raw_text_redacted": redacted,
        },
        "gap": _fixed(observation="capture_health", evidence="unknown") | {
            "boundary": F.coalesce(maybe("boundary"), F.lit("unknown")),
            "coverage": F.coalesce(maybe("coverage"), F.lit("partial")),
            "unsupported_boundary": maybe("unsupportedBoundary"), "notes": maybe("notes"),
            "dropped_events": v.at(_get("$.droppedEvents"), "$", "bigint"),
        },
    }
    columns = _case(F.col("type"), per_type)
    for ids in ("parent_event_ids", "lineage_event_ids"):
        columns[ids] = F.coalesce(columns[ids], F.array().cast("array<string>"))
    attempt = F.coalesce("attempt_id", F.concat(req, F.lit(":a1")))
    extra = {"event_id": F.col("event_id")} if "event_id" in records.columns else {}
    return _finish(rows, columns | extra | {
        "session_id": F.col("session_id"), "producer_seq": F.col("seq"), "wall_time": F.col("wall_time"),
        "request_id": req, "attempt_id": attempt,
        "handler_ordinal": F.when(~F.col("type").isin("usage", "compaction", "extension", "response", "gap"), 0),
        "adapter_id": F.lit(fv.PI_ADAPTER), "adapter_version": F.lit(fv.PI_VERSION),
    }, secret, names)


def default_ancestors(events: DataFrame, biggest: int | None = None) -> DataFrame:
    """Give summaries without ancestors the last eight earlier events of their session.

    Needs dense ``producer_seq`` starting at 1.
    """
    haloed = with_halo(events, "producer_seq", fv.RECENT_SOURCES, biggest)
    frame = Window.partitionBy("session_id", "_segment").orderBy("producer_seq").rowsBetween(-fv.RECENT_SOURCES, -1)
    bare = (F.col("source_category") == "summary") & (F.size("lineage_event_ids") == 0)
    lineage = F.when(bare, F.collect_list("event_id").over(frame)).otherwise(F.col("lineage_event_ids"))
    return haloed.withColumn("lineage_event_ids", lineage).filter(~F.col("_halo")).select(*events.columns)
