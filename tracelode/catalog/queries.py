"""The registered queries: every operator over whole driver tables.

Results carry scalar columns only; id lists are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import variants as v
from ..operators import activity, compare, detectors, graph, matching, metrics, ordered, provenance, seam, services
from ..plans import analysis, topology
from ..session import cut, discard, work_path
from ..sources import adapters, context, lines, reports, sinks, trace_formats
from ..streaming import tail
from . import standin as st

Query = Callable[[SparkSession, str], DataFrame]
PHRASES = ("no,", "stop", "that the", "und die", "les ")


def joined(ids: str | Column) -> Column:
    return F.array_join(ids, ",")


def _evidence(found: DataFrame, *extra: str) -> DataFrame:
    return found.select("session_id", *extra, joined("evidence").alias("evidence"))


def _r(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits)


# --- findings and metrics ---------------------------------------------------


def session_health(spark, sf):
    return analysis.session_health(st.stored_trace(spark, sf))


def repeated_action(spark, sf):
    return _evidence(detectors.repeated_action(st.stored_trace(spark, sf)), "position", "summary")


def alternating_loop(spark, sf):
    return _evidence(detectors.alternating_loop(st.stored_trace(spark, sf)))


def unrecovered_errors(spark, sf):
    return _evidence(detectors.unrecovered_errors(st.stored_trace(spark, sf)), "summary")


def dead_end(spark, sf):
    return _evidence(detectors.dead_end(st.trace(spark, sf)))


def user_correction(spark, sf):
    c = st.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"),
        F.col("turn").cast("string").alias("id"), "role", "text",
    )
    return _evidence(detectors.user_correction(c, PHRASES), "summary")


def dangling_edges(spark, sf):
    return _evidence(detectors.dangling_edges(cut(st.gapped_trace(spark, sf))), "summary")


def session_metrics(spark, sf):
    return metrics.session_metrics(st.trace(spark, sf))


def branches(spark, sf):
    return metrics.branches(st.trace(spark, sf))


def merge_events(spark, sf):
    return metrics.session_metrics(st.lineage(spark, sf)).select("session_id", "events", "edges", "merge_events")


def tool_counts(spark, sf):
    return metrics.tool_counts(st.trace(spark, sf))


def usage_totals(spark, sf):
    return metrics.usage_totals(st.trace(spark, sf)).withColumn("total", _r("total", 2))


def analysis_sink(spark, sf):
    """A whole analysis written as tables, and their rows by session."""
    path = work_path(spark, "analysis")
    analysis.write_analysis(st.stored_trace(spark, sf), path)
    parts = [
        spark.read.parquet(f"{path}/{name}").select("session_id", F.lit(name).alias("part"))
        for name in ("session_metrics", "graph_nodes", "graph_edges", "tool_counts", "usage")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("rows"))


def health_by_file(spark, sf):
    """Health of logs that bear one name in several folders."""
    found = trace_formats.by_source(trace_formats.ingest(st.same_name_lines(spark, sf)))
    return analysis.session_health(cut(found.events)).join(found.sessions.select("session_id", "session_name"), "session_id")


# --- text -------------------------------------------------------------------


def redact_documents(spark, sf):
    text = F.col("text")
    return st.table(spark, sf, "documents").select(
        "doc_id", F.sha2(tx.redacted(text), 256).alias("redacted_sha"), joined(tx.redaction_labels(text)).alias("labels")
    )


def redaction_label_counts(spark, sf):
    rows = st.table(spark, sf, "documents").select("lang", F.explode(tx.redaction_labels(F.col("text"))).alias("label"))
    return rows.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("hits"))


def canonical_fingerprint(spark, sf):
    return st.table(spark, sf, "documents").select(
        "doc_id", tx.fingerprint(F.lit("doc"), F.col("lang"), F.col("text")).alias("fingerprint")
    )


def content_versions(spark, sf):
    rows = st.table(spark, sf, "documents").select("doc_id", tx.content_version(F.col("text"), st.KEY).alias("version"))
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


def secret_like_flag(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", tx.looks_secret(F.col("text")).alias("secret_like"))


def line_hygiene(spark, sf):
    d = st.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")
    )
    return d.select(
        "doc_id", (F.col("line") + 1).cast("bigint").alias("line"), joined(tx.hygiene_labels(F.col("body"))).alias("labels")
    ).filter("labels <> ''")


#: What the stand-in puts behind a page's address, by page.
FILES = ("", "/.env", "/a.pem", "/a.PEM", "/.venv/a.py", "/run.jsonl", "/fixtures/run.jsonl", "/.env.example", "/.env.local", "/.key", "/.state/a")


def page_paths(spark, sf):
    """Paths of private files and of logs outside the fixtures."""
    path = F.concat("url", F.element_at(F.array(*map(F.lit, FILES)), (F.col("page_id") % len(FILES) + 1).cast("int")))
    return st.table(spark, sf, "pages").withColumn("path", path).select(
        "page_id", tx.private_file(F.col("path"), (".state",)).alias("private_name"), tx.stray_log(F.col("path")).alias("stray_log"),
        tx.basename(F.col("path")).alias("basename"),
    )


def sanitize_nested(spark, sf):
    body = F.to_json(F.struct(
        F.col("text").alias("note"),
        F.array(F.struct(F.col("source").alias("api-key"), F.col("lang").alias("lang"))).alias("items"),
        F.struct(F.col("n_chars").alias("DB Password")).alias("login"),
    ))
    rows = st.table(spark, sf, "documents").select("doc_id", v.nested_clean(body).alias("c"))
    return rows.select(
        "doc_id", joined("c.labels").alias("labels"), F.sha2(F.get_json_object("c.value", "$.note"), 256).alias("note_sha"),
        F.get_json_object("c.value", "$.login").alias("login"), F.get_json_object("c.value", "$.items[0].lang").alias("lang"),
    )


def size_estimates(spark, sf):
    t = F.col("text")
    return st.table(spark, sf, "documents").select(
        "doc_id", tx.byte_size(t).alias("bytes"), tx.utf16_length(t).alias("chars"), tx.token_estimate(t).alias("tokens")
    )


# --- ingest -----------------------------------------------------------------


def _events(found: DataFrame) -> DataFrame:
    return found.select(
        "session_id", "seq", "id", "parent_id", "kind", "role", "name", "signature", "is_error",
        F.sha2("text", 256).alias("text_sha"), joined("redactions").alias("redactions"),
        _r(F.aggregate(F.map_values("usage"), F.lit(0.0), lambda a, x: a + x), 2).alias("usage_sum"),
    )


def ingest_generic(spark, sf):
    return _events(trace_formats.ingest(st.generic_lines(spark, sf)).events)


def ingest_pi(spark, sf):
    return _events(trace_formats.ingest(st.pi_lines(spark, sf)).events)


def ingest_loop(spark, sf):
    return _events(trace_formats.ingest(st.loop_lines(spark, sf)).events)


def quarantine(spark, sf):
    raw = st.faulty_lines(spark, sf)
    out = trace_formats.ingest(raw)
    kept = out.events.groupBy("source").agg(F.count(F.lit(1)).alias("events"))
    return out.errors.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows")).unionByName(
        kept.select("source", F.lit("clean").alias("reason"), F.col("events").alias("rows"))
    )


def session_formats(spark, sf):
    """Formats over the three kinds of raw logs together."""
    raw = st.generic_lines(spark, sf).unionByName(st.pi_lines(spark, sf)).unionByName(st.loop_lines(spark, sf))
    tagged = lines.with_format(lines.parse(raw))
    return tagged.groupBy("format").agg(
        F.countDistinct("source").alias("sessions"), F.count(F.lit(1)).alias("lines")
    )


def _loop(spark, sf) -> DataFrame:
    return cut(services.loop_stages(trace_formats.ingest(st.loop_lines(spark, sf)).events))


def loop_metrics(spark, sf):
    return services.loop_metrics(_loop(spark, sf))


def loop_stage_durations(spark, sf):
    return services.stage_durations(_loop(spark, sf)).select("session_id", "stage", "duration_ms")


def loop_bottleneck(spark, sf):
    return _evidence(services.loop_bottleneck(_loop(spark, sf)), "summary")


def loop_gaps(spark, sf):
    stages = _loop(spark, sf)
    found = services.loop_gaps(stages).unionByName(services.agent_timeout(stages))
    return _evidence(found, "code", "summary")


def loop_sessions(spark, sf):
    return trace_formats.loop_sessions(trace_formats.ingest(st.loop_lines(spark, sf)).events)


def loop_adapters(spark, sf):
    return trace_formats.loop_adapters(trace_formats.ingest(st.loop_lines(spark, sf)).events)


# --- reports ----------------------------------------------------------------


def retrieval_metrics(spark, sf):
    return reports.ingest_retrieval(st.retrieval_docs(spark, sf)).sessions.drop("format")


def retrieval_events(spark, sf):
    events = reports.ingest_retrieval(st.retrieval_docs(spark, sf)).events
    return events.select("session_id", "seq", "id", "parent_id", "kind", "is_error", "signature")


def retrieval_findings(spark, sf):
    sessions = reports.ingest_retrieval(st.retrieval_docs(spark, sf)).sessions
    return _evidence(services.escalation_deferred(sessions), "code", "severity")


def contract_metrics(spark, sf):
    return reports.ingest_contract(st.contract_docs(spark, sf)).sessions.drop("format", "source_sha256", "verifier_sha256")


def contract_events(spark, sf):
    events = reports.ingest_contract(st.contract_docs(spark, sf)).events
    return events.select("session_id", "seq", "id", "parent_id", "kind", "is_error")


def contract_findings(spark, sf):
    out = reports.ingest_contract(st.contract_docs(spark, sf))
    return _evidence(services.contract_findings(out.sessions, out.events), "code")


def contract_checks(spark, sf):
    """Required checks with observed verdicts, from exploded tables (J12), and totals from them."""
    o = st.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), "o_orderkey", "o_orderstatus")
    required = o.select("session_id", F.explode(F.array(*[F.lit(c) for c in ("built", "tested", "sent")])).alias("check"))
    li = st.table(spark, sf, "lineitem")
    observed = li.groupBy(F.col("l_orderkey").cast("string").alias("session_id"), F.when(
        F.col("l_linestatus") == "O", "built").when(F.col("l_returnflag") == "N", "tested").otherwise("sent").alias("check")
    ).agg(F.bool_and(F.col("l_quantity") > 5).alias("passed"))
    checks = services.required_checks(required, observed)
    stages = o.select(
        "session_id", F.lit("make").alias("stage"), F.when(F.col("o_orderstatus") == "O", "completed").when(
            F.col("o_orderstatus") == "F", "timeout").alias("status"), F.lit(2.0).alias("duration_ms"))
    return services.contract_totals(stages, checks)


def memory_metrics(spark, sf):
    return reports.ingest_memory(st.memory_docs(spark, sf)).sessions.select(
        "session_id", "backend", "audit_event_count", "turn_total", "turn_abstain", "turn_abstain_rate",
        "proposed_pending_total", "accepted_total", "memory_plane_success",
    )


def memory_events(spark, sf):
    return reports.ingest_memory(st.memory_docs(spark, sf)).events.select("session_id", "seq", "id", "parent_id", "kind")


def memory_findings(spark, sf):
    sessions = reports.ingest_memory(st.memory_docs(spark, sf)).sessions
    return _evidence(services.memory_findings(sessions), "code", "severity")


def memory_findings_by_nation(spark, sf):
    """The same rules over exports of many turns."""
    sessions = reports.ingest_memory(st.memory_docs(spark, sf, by_nation=True)).sessions
    return _evidence(services.memory_findings(sessions), "code", "severity")


def format_health(spark, sf):
    """Health of delivery contracts, retrieval reports and memory exports together, each with its own findings."""
    own = lambda docs, kind: docs.withColumn("session_id", F.concat_ws("-", F.lit(kind), "session_id"))
    return analysis.format_health(
        contract=reports.ingest_contract(own(st.contract_docs(spark, sf), "contract")),
        retrieval=reports.ingest_retrieval(own(st.retrieval_docs(spark, sf), "retrieval")),
        memory=reports.ingest_memory(own(st.memory_docs(spark, sf), "memory")),
    )


# --- comparison and planning ------------------------------------------------


def _measured(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Session metrics with health, findings, and pairs of neighbouring sessions."""
    t = st.stored_trace(spark, sf)
    found = cut(analysis.findings(t))
    base = metrics.session_metrics(t).join(metrics.branches(t), "session_id", "left").fillna(0, ["branches"])
    m = cut(metrics.health(base, found))
    number = F.col("session_id").cast("bigint")
    pairs = m.select(F.col("session_id").alias("before"), (number + 1).cast("string").alias("after"))
    return m, found, pairs


def compare_sessions(spark, sf):
    m, _, pairs = _measured(spark, sf)
    return compare.compare(m, pairs).select("before", "after", "metric", "delta")


def compare_contracts(spark, sf):
    """Delivery contracts compare only with equal digests."""
    got = reports.ingest_contract(st.contract_docs(spark, sf))
    s = got.sessions
    m = s.withColumn(
        "fixture_sha256", F.when(F.col("session_id").cast("bigint") % 7 == 0, F.repeat(F.lit("f"), 64)).otherwise(F.col("fixture_sha256"))
    ).join(analysis.format_health(contract=got), "session_id")
    pairs = s.select(F.col("session_id").alias("before"), (F.col("session_id").cast("bigint") + 1).cast("string").alias("after"))
    out = compare.compare(m, pairs)
    return out.filter("refused is not null or metric in ('pipeline_success', 'pipeline_checks_passed', 'pipeline_duration_ms')")


def scorecard(spark, sf):
    m, found, pairs = _measured(spark, sf)
    return compare.scorecard(m, found, pairs).select(
        "before", "after", "ok", joined("failed_gates").alias("failed_gates"), "health_delta", "finding_delta",
        "new_dangling", joined("new_critical").alias("new_critical"),
    )


def topology_rank(spark, sf):
    return topology.ranked_findings(analysis.findings(st.stored_trace(spark, sf))).select("session_id", "rank", "code", "role")


def topology_plan(spark, sf):
    t = st.stored_trace(spark, sf)
    plan = topology.topology_plan(t.select("session_id").distinct(), analysis.findings(t), include_healthy=True)
    return plan.select(
        "session_id", "primary_finding", joined("findings_used").alias("findings_used"), joined("flags").alias("flags"),
        joined("phases").alias("phases"), "node_sequence",
    )


# --- graphs -----------------------------------------------------------------


def edge_list(spark, sf):
    return graph.edges(st.lineage(spark, sf)).select("session_id", "src", "dst", "relation")


def relation_counts(spark, sf):
    return metrics.relation_counts(graph.edges(st.lineage(spark, sf)))


def roots_leaves(spark, sf):
    t = st.lineage(spark, sf)
    n, e = graph.nodes(t), graph.edges(t)
    ends = graph.roots(n, e).withColumn("end", F.lit("root")).unionByName(graph.leaves(n, e).withColumn("end", F.lit("leaf")))
    return ends.groupBy("session_id", "end").agg(F.count(F.lit(1)).alias("nodes"))


def implicit_nodes(spark, sf):
    t = st.lineage(spark, sf)
    return graph.implicit_nodes(graph.nodes(t), graph.edges(t))


def graph_issues(spark, sf):
    """Duplicate and blank ids over a raw node table."""
    ev = st.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("id"),
        F.col("event_type").alias("kind"),
    )
    e = ev.select("session_id", F.nullif("id", F.lit("7")).alias("src"), F.col("kind").alias("dst"),
                  F.when(F.col("kind") == "error", "").otherwise("next").alias("relation"))
    return graph.graph_issues(ev, e).groupBy("session_id", "issue").agg(F.count(F.lit(1)).alias("rows"))


def artifact_coverage(spark, sf):
    t = st.lineage(spark, sf)
    n, e = graph.nodes(t), graph.edges(t)
    changed = graph.changed_artifacts(e).groupBy("session_id").agg(F.count(F.lit(1)).alias("changed"))
    proven = graph.verified_artifacts(n, e).groupBy("session_id").agg(F.count(F.lit(1)).alias("verified"))
    both = changed.join(proven, "session_id", "left").fillna(0, ["verified"])
    return both.withColumn("coverage", _r(tx.ratio(F.col("verified"), F.col("changed"))))


def _lineage_graph(spark, sf):
    t = cut(st.lineage(spark, sf))
    n = graph.nodes(t)
    g = graph.contract(graph.edges(t), n)
    if not g.any_open:
        discard(g.links)  # read for rings alone
    return t, n, g


def request_outputs(spark, sf):
    _, n, g = _lineage_graph(spark, sf)
    outputs = n.filter(graph.is_output()).groupBy("session_id").agg(F.count(F.lit(1)).alias("outputs"))
    reached = graph.reachable_outputs(n, g).groupBy("session_id").agg(F.count(F.lit(1)).alias("reachable"))
    return outputs.join(reached, "session_id", "left").fillna(0, ["reachable"])


def components(spark, sf):
    t, _, g = _lineage_graph(spark, sf)
    discard(t)
    out = graph.components(g)
    discard(g.merges)  # its labels are stored
    return out


def graph_depth(spark, sf):
    t = st.stored_trace(spark, sf)
    return graph.graph_depth(graph.contract(graph.edges(t), graph.nodes(t)))


def lineage_depth(spark, sf):
    t, _, g = _lineage_graph(spark, sf)
    discard(t)
    return graph.graph_depth(g)


def cycle_nodes(spark, sf):
    e = cut(st.ring_edges(spark, sf))
    return graph.cycle_nodes(graph.contract(e, st.ring_nodes(e)))


# --- context captures -------------------------------------------------------

_SHOWN = (
    "session_id", "event_id", "producer_seq", "request_id", "attempt_id", "observation", "evidence", "boundary", "coverage",
    "source_category", "source_alias", "source_key", "content_version_key", "estimated_tokens", "byte_count", "char_count",
    "match_method", "tool_call_id", "usage_input_tokens", "usage_output_tokens",
)


def context_events(spark, sf):
    valid = context.valid(st.context(spark, sf))
    return valid.select(
        *_SHOWN, joined("parent_event_ids").alias("parents"), joined("lineage_event_ids").alias("lineage"),
        F.col("source_range.start").alias("range_start"), F.col("source_range.end").alias("range_end"),
    )


def event_query(spark, sf):
    found = context.query(st.context(spark, sf), observation="usage", adapter_id="pi")
    return found.select("session_id", "event_id", "producer_seq", "request_id", "usage_input_tokens")


def event_index(spark, sf):
    """Write the derived table, read one column set back with counts per session."""
    path = work_path(spark, "index")
    context.write_index(st.context(spark, sf), path, buckets=8, files_per_bucket=1)
    return context.event_count(context.read_index(spark, path))


def event_lookup(spark, sf):
    """All rows of the source key that the most events share, by the key filters of the derived table."""
    path = work_path(spark, "index")
    context.write_index(st.context(spark, sf), path, buckets=8, files_per_bucket=2)
    keys = context.read_index(spark, path).filter(F.col("source_key").isNotNull()).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    top = keys.agg(F.max_by("source_key", F.struct("n", "source_key")).alias("k")).first()["k"]
    return context.lookup(spark, path, "source_key", top or "").select("session_id", "event_id", "producer_seq", "source_key")


def event_index_digest(spark, sf):
    return context.index_digest(st.context(spark, sf))


def default_ancestors(spark, sf):
    """Summaries that name no ancestor take the eight events before them."""
    events, segment = ordered.by_count(st.context(spark, sf), ["session_id"], ["producer_seq"])
    rows = ordered.running(events, ["session_id"], ["producer_seq"], [ordered.Running("no", "count")], segment).withColumn("producer_seq", F.col("no").cast("bigint")).withColumns({
        "source_category": F.when(F.col("observation") == "usage", "summary").otherwise(F.col("source_category")),
    }).drop("no")
    return adapters.default_ancestors(rows).filter("observation = 'usage'").select(
        "event_id", joined("lineage_event_ids").alias("lineage")
    )


def codex_ingest(spark, sf):
    events = adapters.codex_rollout(st.rollout_lines(spark, sf), st.KEY)
    return events.select(
        "session_id", "producer_seq", "request_id", "observation", "boundary", "coverage", "source_alias", "source_key",
        "content_version_key", "byte_count", "dropped_events", "usage_input_tokens", "usage_output_tokens",
        (F.size("parent_event_ids") > 0).alias("answers_user"),
    )


def turn_assignment(spark, sf):
    """Turn number and the user message each answer belongs to."""
    events = cut(adapters.codex_rollout(st.rollout_lines(spark, sf), st.KEY))
    asked = events.filter("boundary = 'transcript.user_message'").select(
        F.col("event_id").alias("asked_id"), F.col("producer_seq").alias("asked_seq")
    )
    answers = events.filter("observation = 'response'").select(
        "session_id", "producer_seq", "request_id", F.get("parent_event_ids", F.lit(0)).alias("asked_id")
    )
    return answers.join(asked, "asked_id", "left").drop("asked_id")


def codex_history(spark, sf):
    c = st.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("seq"),
        F.col("turn").alias("ts"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"),
    )
    return adapters.codex_history(c, st.KEY).select(
        "session_id", "producer_seq", "request_id", "source_key", "content_version_key", "estimated_tokens"
    )


def claude_ingest(spark, sf):
    return adapters.claude_hooks(st.hook_records(spark, sf), st.KEY).select(
        "session_id", "producer_seq", "request_id", "observation", "evidence", "boundary", "coverage", "source_category",
        "source_alias", "source_key", "content_version_key", "byte_count", "unsupported_boundary",
    )


def tool_ranges(spark, sf):
    """Tool arguments made from order lines: reads, edits, searches and others."""
    li = st.table(spark, sf, "lineitem")
    tool = F.when(F.col("l_linenumber").isin(1, 2), "Read").when(F.col("l_linenumber") == 3, "edit").when(
        F.col("l_linenumber").isin(4, 5), "grep").otherwise("bash")
    path = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("/src/"), F.col("l_partkey").cast("string")))
    args = F.to_json(F.struct(
        path.alias("path"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("offset"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("limit"),
        F.when(F.col("l_linenumber") == 4, F.lit("TODO")).alias("pattern"),
    ))
    span = adapters.tool_span(tool, F.parse_json(args))
    rows = li.select(tool.alias("tool"), *[c.alias(n) for n, c in span.items()])
    return rows.groupBy(
        "tool", "path", F.col("range.start").alias("start"), F.col("range.end").alias("end"), "match_method",
        "observation", "coverage",
    ).agg(F.count(F.lit(1)).alias("calls"))


def payload_fields(spark, sf):
    payloads = st.match_inputs(st.host_records(spark, sf))[1]
    fields = matching.payload_fields(payloads.select("event_id", "payload"))
    return fields.select("event_id", "pointer", tx.byte_size(F.col("text")).alias("bytes"), F.sha2("text", 256).alias("text_sha"))


def text_matches(spark, sf):
    found = matching.text_matches(*st.match_inputs(cut(st.host_records(spark, sf))))
    return found.select("source_id", "payload_id", "pointer", "hits", "span.start", "span.end")


def containment(spark, sf):
    docs = st.table(spark, sf, "documents").select("doc_id", "text")
    return matching.containment(docs, st.table(spark, sf, "benchmark").select("item_id", "text"))


def containment_short(spark, sf):
    """Sources of one to three words and of parts of words: the first words of every benchmark item, and their first letters."""
    docs = st.table(spark, sf, "documents").select("doc_id", "text")
    first = F.split("text", " ")
    items = st.table(spark, sf, "benchmark").select("item_id", F.explode(F.array(
        F.array_join(F.slice(first, 1, 3), " "), F.array_join(F.slice(first, 1, 2), " "), F.concat(F.substring("text", 1, 3), F.lit(". ")),
    )).alias("text")).distinct()
    return matching.containment(docs, items).groupBy("item_id", "doc_id", "start").agg(
        F.count(F.lit(1)).alias("sources"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def recent_sources(spark, sf):
    """Answers of a session against the user and system turns before them, eight at most."""
    c = st.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.lit("all").alias("request_id"), F.col("turn").alias("seq"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), "role",
    )
    found = matching.recent_sources(c.filter("role <> 'assistant'"), c.filter("role = 'assistant'"))
    return found.select("payload_id", "source_id", "source_no")


def match_health(spark, sf):
    """Buffer gaps: documents as sources of one turn per source, payloads without known text."""
    d = st.table(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("lang").alias("request_id"), F.col("doc_id").alias("seq"), "text"
    )
    p = d.withColumn("payload", F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.col("text").alias("input")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("other")))))
    gaps = matching.source_health(d).unionByName(matching.payload_health(p))
    return gaps.groupBy("session_id", "request_id", "boundary").agg(F.count(F.lit(1)).alias("rows"))


# --- provenance -------------------------------------------------------------


def prov_nodes(spark, sf):
    return provenance.prov_nodes(st.context(spark, sf))


def prov_edges(spark, sf):
    return provenance.prov_edges(st.capture(spark, sf)).groupBy("session_id", "from", "to", "kind", "ambiguous").agg(
        F.count(F.lit(1)).alias("edges")
    )


def prov_issues(spark, sf):
    return provenance.prov_issues(st.capture(spark, sf)).groupBy("session_id", "code").agg(F.count(F.lit(1)).alias("issues"))


def ambiguous_matches(spark, sf):
    events = st.capture(spark, sf)
    edges = cut(provenance.visible_edges(events, provenance.candidate_links(events)))
    return provenance.ambiguous_matches(events, edges).select("from", "to")


def request_inspection(spark, sf):
    return provenance.request_inspection(st.capture(spark, sf))


def request_list(spark, sf):
    return provenance.prov_requests(st.context(spark, sf))


def capture_problems(spark, sf):
    """Sessions whose capture cannot form a graph; every fifth conversation repeats an event id."""
    events = st.context(spark, sf)
    number = F.regexp_extract("session_id", r"(\d+)", 1).cast("int")
    again = events.filter((number % 5 == 0) & (F.col("producer_seq") == 0))
    return provenance.unusable(events.unionByName(again))


def _spoiled_log(spark, sf) -> str:
    """The capture as text, with what must be refused: by conversation, a repeated row, a foreign schema, a missing
    field, a damaged line, or an observation that nobody knows."""
    events = st.context(spark, sf)
    number = F.regexp_extract("session_id", r"(\d+)", 1).cast("int") % 5
    first = events.filter(F.col("producer_seq") == 0)
    renamed = first.withColumn("event_id", F.concat(F.lit("extra-"), "event_id"))
    every = reduce(DataFrame.unionByName, [
        events, first.filter(number == 0), renamed.filter(number == 1).withColumn("schema_version", F.lit("other.v1")),
        renamed.filter(number == 2).withColumn("agent_id", F.lit(None).cast("string")),
        renamed.filter(number == 4).withColumn("observation", F.lit("guess")),
    ])
    text = context.to_log(every).select(F.to_json(F.struct("*")).alias("value"))
    damaged = first.filter(number == 3).select(F.concat(F.lit('{"eventId": "'), "event_id").alias("value"))
    folder = work_path(spark, "log")
    text.unionByName(damaged).write.text(folder)
    return folder


def context_scan(spark, sf):
    """Events kept and rows refused of a log with foreign, invalid and damaged rows."""
    events, rejects = context.scan(spark, _spoiled_log(spark, sf))
    kept = events.groupBy().agg(F.lit("valid").alias("reason"), F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def admitted_graph(spark, sf):
    """Per session: nodes, edges and issues of the captures admitted, and the reason of those refused."""
    events, _ = context.scan(spark, _spoiled_log(spark, sf))
    found = provenance.provenance(events)
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    out = count(found.nodes, "nodes").join(count(found.edges, "edges"), "session_id", "full").join(
        count(found.issues, "issues"), "session_id", "full").join(found.refused.select("session_id", "reason"), "session_id", "full")
    return out.fillna(0, ["nodes", "edges", "issues"])


def request_sources(spark, sf):
    """Matched and unmatched sources of each session's last request."""
    events = st.capture(spark, sf)
    last = events.filter(F.col("observation").isin("payload", "dispatch")).groupBy("session_id").agg(
        F.max_by("event_id", "producer_seq").alias("request"))
    return provenance.request_sources(events, cut(provenance.prov_edges(events)), last)


# --- activity ---------------------------------------------------------------


def activity_steps(spark, sf):
    steps = activity.activity_steps(st.context(spark, sf))
    return steps.select(
        "session_id", "event_id", "seq", "wall_time", "phase", "agent_runtime", "title", "path", "tool_name", "request_id",
        "coverage", "boundary", "derived", F.col("range.start").alias("range_start"), F.col("range.unit").alias("range_unit"),
    )


def activity_order(spark, sf):
    """Positions read back from the table of steps written in total order."""
    path = work_path(spark, "steps")
    activity.write_steps(activity.activity_steps(st.context(spark, sf)), path)
    return spark.read.parquet(path).select("session_id", "event_id", "position", "phase")


def activity_counts(spark, sf):
    return activity.activity_counts(activity.activity_steps(st.context(spark, sf)))


def activity_gaps(spark, sf):
    return activity.gap_steps(activity.recorded_steps(st.context(spark, sf))).select("session_id", "request_id", "seq", "wall_time")


def turn_order(spark, sf):
    return activity.turn_order(activity.activity_steps(st.context(spark, sf)))


# --- exports ----------------------------------------------------------------


def seam_export(spark, sf):
    rows = seam.generic_rows(st.context(spark, sf))
    relations = F.array_sort(F.transform(F.map_entries("parent_relations"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select(
        "id", "parent_id", joined("parent_ids").alias("parent_ids"), joined(relations).alias("relations"), "kind", "role",
        "name", "is_error", F.size("usage").cast("bigint").alias("counters"),
        F.col("provenance.session_id").alias("session_id"), F.col("provenance.source_key").alias("source_key"),
    )


def seam_sink(spark, sf):
    """Write the export as JSON lines, ingest it back as a generic trace, count its edges by relation."""
    path = work_path(spark, "export")
    events = st.context(spark, sf)
    sinks.write_generic_jsonl(events, path)
    back = spark.read.text(path).select(
        F.concat(F.lit("export/"), F.get_json_object("value", "$.provenance.session_id"), F.lit(".jsonl")).alias("source"),
        F.get_json_object("value", "$.timestamp").alias("at"), F.col("value").alias("line"),
    )
    placed = st._numbered_lines(back, ["at"])
    return metrics.relation_counts(graph.edges(trace_formats.ingest(placed).events))


def provenance_join(spark, sf):
    events = context.own_events(st.context(spark, sf))
    nodes = graph.nodes(seam.as_trace(events)).filter("kind <> 'context_usage'")
    return seam.join_last(nodes, events)


def provenance_join_strict(spark, sf):
    events = st.context(spark, sf)
    nodes = graph.nodes(seam.as_trace(events)).filter("kind = 'context_response'")
    return seam.join_unique(nodes, events)


def safe_projection(spark, sf):
    safe = seam.safe_projection(st.context(spark, sf))
    return safe.select(
        "event_id", "source_alias", "raw_text", "source_path", "raw_text_redacted", F.col("source_range.start").alias("start")
    )


# --- streams ----------------------------------------------------------------


#: The stand-in's clocks differ by less, and no turn of it is resumed after a longer silence.
LATENESS, IDLE_MS = "1 hour", 24 * 3600 * 1000
#: Short enough for rows of the stand-in to be late.
SOON = "10 seconds"


def _closing(events: DataFrame) -> DataFrame:
    """The row by which a recorder closes its log, far behind the last event."""
    last = events.groupBy().agg(F.max_by(F.struct(*events.columns), F.struct("wall_time", "event_id")).alias("x"), F.max(tail.event_time()).alias("at"))
    closing = {
        "event_id": F.lit("closing"), "session_id": F.lit("closing"), "observation": F.lit(tail.CLOSED[0]), "boundary": F.lit(tail.CLOSED[1]),
        "wall_time": F.date_format(F.col("at") + F.expr("interval 30 days"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    }
    return last.select("x.*", "at").withColumns(closing).select(*events.columns)


def _log_folder(spark, sf, events: DataFrame | None = None, by: str = "sessionId") -> str:
    """The capture as a folder of JSON log files, the input of the stream queries; the last file closes the log."""
    folder = work_path(spark, "log")
    events = st.context(spark, sf) if events is None else events
    context.to_log(events).repartition(4, by).write.json(folder)
    context.to_log(_closing(events)).coalesce(1).write.mode("append").json(folder)
    return folder


def _drained(spark, stream: DataFrame) -> DataFrame:
    """Run a stream over everything that is there and read its table back."""
    table = work_path(spark, "sink")
    query = tail.append(stream, table, work_path(spark, "state"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def stream_tail(spark, sf):
    out = _drained(spark, tail.read_log(spark, _log_folder(spark, sf), files_per_batch=2).filter(~tail.is_closing()))
    return out.select("session_id", "event_id", "producer_seq", "observation", "byte_count")


def stream_late(spark, sf):
    """Every row of a log whose files come in the wrong order, on time or late, by the newest row of earlier batches."""
    events = st.context(spark, sf)
    folder = work_path(spark, "log")
    # The newest rows come first, so what is more than ten seconds older is late.
    newest = tail.event_time() == F.lit(events.agg(F.max(tail.event_time())).first()[0])
    context.to_log(events.filter(newest)).coalesce(1).write.json(folder)
    context.to_log(events.filter(~newest)).coalesce(1).write.mode("append").json(folder)
    on_time, late, marks = (work_path(spark, name) for name in ("ontime", "late", "marks"))
    stream = tail.read_log(spark, folder, files_per_batch=1)
    tail.split_late(stream, on_time, late, marks, work_path(spark, "state"), SOON, available_now=True).awaitTermination()
    kept = spark.read.parquet(on_time).select("session_id", "event_id", "producer_seq", F.lit("on_time").alias("dealt"))
    return kept.unionByName(spark.read.parquet(late).select("session_id", "event_id", "producer_seq", F.col("reason").alias("dealt")))


def stream_gaps(spark, sf):
    events = tail.read_log(spark, _log_folder(spark, sf, by="eventId"), files_per_batch=1)
    return _drained(spark, tail.turn_gaps(events, LATENESS, IDLE_MS))


def stream_gaps_batch(spark, sf):
    return tail.turn_gaps_batch(st.context(spark, sf))


def stream_sources(spark, sf):
    events = tail.with_time(tail.read_log(spark, _log_folder(spark, sf)), LATENESS)
    is_source = F.when(~tail.is_closing(), F.col("observation") == "load")
    marks = events.filter(
        F.col("source_category").isin("user_input", "system_input") | F.col("observation").isin("payload", "dispatch") | tail.is_closing()
    ).select("session_id", "request_id", "producer_seq", "event_id", "event_time", is_source.alias("is_source"))
    return _drained(spark, tail.recent_sources(marks, IDLE_MS))


def stream_drops(spark, sf):
    """Broken transcript lines as drop records; the running total per session as a stream."""
    events = adapters.codex_rollout(st.rollout_lines(spark, sf), st.KEY)
    logged = events.withColumns({"wall_time": F.lit("2026-01-01T00:00:00.000Z"), "agent_id": F.lit("agent-main")})
    stream = tail.with_time(tail.read_log(spark, _log_folder(spark, sf, logged)), LATENESS)
    drops = stream.filter("observation = 'capture_health'").select(
        "session_id", "producer_seq", "event_id", F.when(~tail.is_closing(), F.lit(1).cast("bigint")).alias("dropped"), "event_time"
    )
    return _drained(spark, tail.cumulative_drops(drops, IDLE_MS)).select("session_id", "seq", "dropped", "cumulative")


def stream_unique(spark, sf):
    """Repeated event ids are dropped within the watermark."""
    events = st.context(spark, sf)
    folder = work_path(spark, "log")
    context.to_log(events.unionByName(events.filter("producer_seq % 3 = 0"))).repartition(4, "eventId").write.json(folder)
    return _drained(spark, tail.without_repeats(tail.read_log(spark, folder), LATENESS)).select("session_id", "event_id", "producer_seq")


ALL: tuple[Query, ...] = (
    session_health, repeated_action, alternating_loop, unrecovered_errors, dead_end, user_correction, dangling_edges,
    session_metrics, branches, merge_events, tool_counts, usage_totals, analysis_sink,
    redact_documents, redaction_label_counts, canonical_fingerprint, content_versions, secret_like_flag, line_hygiene,
    page_paths, sanitize_nested, size_estimates,
    ingest_generic, ingest_pi, ingest_loop, quarantine, session_formats,
    loop_metrics, loop_stage_durations, loop_bottleneck, loop_gaps, loop_sessions, loop_adapters,
    retrieval_metrics, retrieval_events, retrieval_findings, contract_metrics, contract_events, contract_findings,
    contract_checks, memory_metrics, memory_events, memory_findings,
    memory_findings_by_nation, health_by_file, format_health, compare_sessions, compare_contracts, scorecard, topology_rank, topology_plan,
    edge_list, relation_counts, roots_leaves, implicit_nodes, graph_issues, artifact_coverage, request_outputs, components,
    graph_depth, lineage_depth, cycle_nodes,
    context_events, event_query, event_index, event_lookup, event_index_digest, default_ancestors, codex_ingest, turn_assignment,
    codex_history, claude_ingest, tool_ranges, payload_fields, text_matches, containment, containment_short, recent_sources, match_health,
    prov_nodes, prov_edges, prov_issues, ambiguous_matches, request_inspection, request_list, capture_problems,
    context_scan, admitted_graph, request_sources,
    activity_steps, activity_order, activity_counts, activity_gaps, turn_order,
    seam_export, seam_sink, provenance_join, provenance_join_strict, safe_projection,
    stream_tail, stream_late, stream_gaps, stream_gaps_batch, stream_sources, stream_drops, stream_unique,
)
