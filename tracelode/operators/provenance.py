"""Provenance graph of context events: nodes, edges, issues and request inspection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import cut
from . import ancestors, graph
from .detectors import union_all

REQUEST = ("session_id", "agent_id", "request_id", "attempt_id")
SUMMARY, MATCH, RESPONSE, PARENT = "summary_ancestor", "observed_text_match", "response_to", "recorded_parent"


def node_kind() -> Column:
    """Kind of a node from its observation."""
    obs = F.col("observation")
    return (
        F.when(obs == "response", "response").when(obs.isin("payload", "dispatch"), "request")
        .when(obs == "transform", "transform").when(obs.isin("usage", "capture_health"), "telemetry").otherwise("source")
    )


def category_label() -> Column:
    labels = F.create_map(*[F.lit(x) for pair in fv.CATEGORY_LABELS.items() for x in pair])
    return F.coalesce(labels[F.col("source_category")], F.nullif("source_category", F.lit("")), F.lit("Observation"))


def unusable(events: DataFrame) -> DataFrame:
    """Sessions whose capture cannot form a graph: repeated ids, unknown observations, bad id lists."""
    ids = F.concat("parent_event_ids", "lineage_event_ids")
    bad = (
        ~F.coalesce(F.col("observation").isin(*fv.OBSERVATIONS), F.lit(False)) | (F.length("event_id") == 0)
        | F.exists(ids, lambda i: i.isNull() | (i == ""))
    )
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("event_id")
    repeated = events.join(twice, "event_id", "left_semi").select("session_id")
    return events.filter(F.coalesce(bad, F.lit(True))).select("session_id").unionByName(repeated).distinct()


def admit(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the captures that can form a graph, and the captures refused: session_id, reason, rows.

    A capture with one unusable row is refused whole, for the first reason by name. Events are marked once; both
    results read what is stored. Graph operators should be given the events admitted here.
    """
    ids = F.concat("parent_event_ids", "lineage_event_ids")
    fault = (
        F.when(F.coalesce(F.length("event_id"), F.lit(0)) == 0, "blank_event_id")
        .when(F.col("session_id").isNull() | F.col("agent_id").isNull(), "missing_field")
        .when(F.coalesce(F.exists(ids, lambda i: i.isNull() | (i == "")), F.lit(True)), "bad_id_list")
        .when(~F.coalesce(F.col("observation").isin(*fv.OBSERVATIONS), F.lit(False)), "unknown_observation")
    )
    # Copies collapse in each task before the shuffle, so an id that many rows have is no hot key.
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    marked = cut(events.withColumn("_fault", fault).join(twice, "event_id", "left").withColumn(
        "_fault", F.coalesce("_fault", F.when(F.col("_copies") > 1, "repeated_event_id"))).drop("_copies"))
    refused = marked.filter(F.col("_fault").isNotNull()).groupBy("session_id").agg(
        F.min("_fault").alias("reason"), F.count(F.lit(1)).alias("rows"))
    good = marked.filter(F.col("_fault").isNull()).drop("_fault")
    return good.join(refused.select("session_id"), "session_id", "left_anti").select(*events.columns), refused


@dataclass
class Provenance:
    """The graph of all captures admitted, and the captures refused."""

    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    refused: DataFrame


def provenance(events: DataFrame) -> Provenance:
    """Nodes, edges and issues of the captures that can form a graph; nothing of the others."""
    accepted, refused = admit(events)
    return Provenance(prov_nodes(accepted), prov_edges(accepted), prov_issues(accepted), refused)


def prov_nodes(events: DataFrame) -> DataFrame:
    """Everything but inclusion records, with kind, category and label."""
    kind = node_kind()
    label = F.coalesce(
        F.nullif("source_alias", F.lit("")),
        F.when(kind == "request", "Payload snapshot").when(kind == "response", "Model response").otherwise(F.col("observation")),
    )
    return events.filter(F.col("observation") != "inclusion").select(
        F.col("event_id").alias("id"), kind.alias("kind"), category_label().alias("category"), label.alias("label"),
        *REQUEST, "observation",
    )


def _end(events: DataFrame, prefix: str) -> DataFrame:
    """Attributes of a referenced event, keyed by ``prefix``."""
    keep = ("observation", *REQUEST, "content_version_key", "source_key", "evidence")
    return events.select(F.col("event_id").alias(prefix), F.struct(*keep).alias(f"{prefix}_e"))


def _same_request(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for key in REQUEST:
        out = out & a[key].eqNullSafe(b[key])
    return out


def candidate_links(events: DataFrame) -> DataFrame:
    """Every claimed relation with its verdict: an edge kind or an issue.

    Columns: session_id, from, to, kind, evidence_id, issue.
    """
    plain = events.filter(F.col("observation") != "inclusion")
    own = F.struct("observation", *REQUEST).alias("own")
    claims = plain.select(
        "session_id", F.col("event_id").alias("to"), own,
        F.explode(F.concat(
            F.transform(F.array_distinct("parent_event_ids"), lambda p: F.struct(p.alias("from"), F.lit(False).alias("lineage"))),
            F.transform(F.array_distinct("lineage_event_ids"), lambda p: F.struct(p.alias("from"), F.lit(True).alias("lineage"))),
        )).alias("c"),
    ).select("session_id", "to", "own", F.col("c.from").alias("from"), F.col("c.lineage").alias("lineage"))
    met = claims.join(_end(events, "from"), "from", "left")
    p = F.col("from_e")
    answers = ~F.col("lineage") & (F.col("own.observation") == "response") & F.coalesce(
        p["observation"].isin("payload", "dispatch"), F.lit(False)
    )
    issue = (
        F.when(answers & ~_same_request(p, F.col("own")), "response_request_mismatch")
        .when(p.isNull(), "missing_parent").when(p["session_id"] != F.col("session_id"), "cross_session_link")
    )
    direct = met.select(
        "session_id", "from", "to",
        F.when(F.col("lineage"), SUMMARY).when(answers, RESPONSE).otherwise(PARENT).alias("kind"),
        F.col("to").alias("evidence_id"), issue.alias("issue"),
    )
    claimed = events.filter(F.col("observation") == "inclusion").select(
        "session_id", F.col("event_id").alias("evidence_id"), F.get("parent_event_ids", F.lit(0)).alias("from"),
        F.get("parent_event_ids", F.lit(1)).alias("to"), F.size("parent_event_ids").alias("n"),
        F.struct(*REQUEST, "content_version_key", "source_key", "evidence", "source_span", "request_span", "match_method").alias("e"),
    )
    joined = claimed.join(_end(events, "from"), "from", "left").join(_end(events, "to"), "to", "left")
    s, t, e = F.col("from_e"), F.col("to_e"), F.col("e")
    span = lambda r: (r["start"] >= 0) & (r["end"] > r["start"])
    sound = (
        (F.col("n") == 2) & s.isNotNull() & t.isNotNull() & t["observation"].isin("payload", "dispatch")
        & s["observation"].isin("inventory", "load", "read", "transform")
        & (F.length(s["content_version_key"]) > 0) & (e["content_version_key"] == s["content_version_key"])
        & e["source_key"].eqNullSafe(s["source_key"]) & _same_request(e, t) & (s["agent_id"] == t["agent_id"])
        & span(e["source_span"]) & span(e["request_span"])
        & F.coalesce(e["match_method"], F.lit("")).startswith(fv.EXACT_MATCH_PREFIX)
        & (e["evidence"] == t["evidence"]) & e["evidence"].isin("payload_snapshot", "final_dispatch")
    )
    matched = joined.select(
        "session_id", "from", "to", F.lit(MATCH).alias("kind"), "evidence_id",
        F.when(~F.coalesce(sound, F.lit(False)), "unverified_match")
        .when(s["session_id"] != t["session_id"], "cross_session_link").alias("issue"),
    )
    return direct.unionByName(matched)


def visible_edges(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Accepted edges between two nodes; edges that touch an inclusion record are hidden."""
    hidden = events.filter(F.col("observation") == "inclusion").select("event_id")
    good = claims.filter(F.col("issue").isNull()).drop("issue").dropDuplicates(["from", "to", "kind", "evidence_id"])
    # Only a parent can be an inclusion record here: children are nodes and matches end in payloads.
    return good.join(hidden.withColumnRenamed("event_id", "from"), "from", "left_anti")


def ambiguous_matches(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Match edges that share payload, method and span with another."""
    spans = events.filter(F.col("observation") == "inclusion").select(
        F.col("event_id").alias("evidence_id"), "match_method", "request_span"
    )
    keyed = edges.filter(F.col("kind") == MATCH).join(spans, "evidence_id")
    key = ["to", "match_method", "request_span"]
    shared = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keyed.join(shared, key, "left_semi").select("session_id", "from", "to", "kind", "evidence_id")


def prov_edges(events: DataFrame) -> DataFrame:
    """Visible edges with the ambiguity mark."""
    edges = cut(visible_edges(events, candidate_links(events)))
    unclear = ambiguous_matches(events, edges).select("evidence_id", F.lit(True).alias("ambiguous"))
    marked = edges.join(unclear, "evidence_id", "left")
    return marked.select(
        "session_id", "from", "to", "kind", "evidence_id",
        (F.coalesce("ambiguous", F.lit(False)) & (F.col("kind") == MATCH)).alias("ambiguous"),
    )


def cyclic_sessions(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions whose visible edges form a cycle."""
    rows = edges.select("session_id", F.col("from").alias("src"), F.col("to").alias("dst"), F.col("kind").alias("relation"))
    ends = rows.select("session_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    bare = ends.select("session_id", "id", F.lit("node").alias("kind"), F.lit(None).cast("string").alias("role"))
    return graph.graph_depth(graph.contract(rows, bare)).filter("not is_dag").select("session_id")


def prov_issues(events: DataFrame) -> DataFrame:
    """All issues: session_id, code, event_id."""
    claims = cut(candidate_links(events))
    edges = cut(visible_edges(events, claims))
    row = lambda df, code, event: df.select("session_id", F.lit(code).alias("code"), F.col(event).alias("event_id"))
    rejected = claims.filter(F.col("issue").isNotNull()).select(
        "session_id", F.col("issue").alias("code"), F.col("evidence_id").alias("event_id")
    )
    refused = claims.filter(F.col("issue") == "unverified_match").select(F.col("evidence_id").alias("event_id"))
    gaps = events.filter(
        (F.col("coverage") != "full") | F.coalesce("truncation", F.lit(False)) | (F.coalesce("dropped_events", F.lit(0)) > 0)
    ).join(refused, "event_id", "left_anti")
    inclusion = events.filter(F.col("observation") == "inclusion").select(F.col("event_id").alias("from"))
    hidden = claims.filter(F.col("issue").isNull()).join(inclusion, "from", "left_semi")
    cycles = cyclic_sessions(events, edges).withColumn("event_id", F.lit(None).cast("string"))
    return union_all([
        rejected, row(gaps, "capture_gap", "event_id"), row(hidden, "hidden_reference", "evidence_id"),
        row(cycles, "cycle", "event_id"), row(ambiguous_matches(events, edges), "ambiguous_match", "evidence_id"),
    ])


def prov_requests(events: DataFrame) -> DataFrame:
    """Payload snapshots."""
    return events.filter(F.col("observation").isin("payload", "dispatch")).select(
        "session_id", F.col("event_id").alias("id"),
        F.coalesce(F.nullif("request_id", F.lit("")), F.lit("Unidentified request")).alias("label"),
        F.col("attempt_id").alias("attempt"),
    )


def ancestor_counts(events: DataFrame, edges: DataFrame) -> DataFrame:
    """request and the number of its ancestors: matched sources and everything behind them over summary edges."""
    matches = edges.filter(F.col("kind") == MATCH).select(F.col("to").alias("request"), F.col("from").alias("id")).distinct()
    links = edges.filter(F.col("kind") == SUMMARY).select(F.col("from").alias("id"), F.col("to").alias("up")).distinct()
    used = matches.select("id").unionByName(links.select(F.explode(F.array("id", "up")).alias("id"))).distinct()
    # An id that occurs twice has one place, its first.
    places = used.join(events.select(F.col("event_id").alias("id"), "producer_seq"), "id", "left").groupBy("id").agg(
        F.min("producer_seq").alias("seq"))
    return ancestors.behind(matches, cut(links), cut(places))


def _null_key(prefix: str = "") -> list[Column]:
    """Null-safe join key columns of a request identity."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(f"{prefix}{c}") for c in REQUEST]


def request_inspection(events: DataFrame) -> DataFrame:
    """Every request with its match, response, ancestor, candidate, unmatched and usage counts."""
    edges = cut(prov_edges(events))
    requests = events.filter(F.col("observation").isin("payload", "dispatch")).select(
        F.col("event_id").alias("request"), "session_id", "agent_id",
        F.sha2(F.concat_ws("/", *_null_key()), 256).alias("request_key"),
    )
    count = lambda df, name: df.groupBy("request").agg(F.count(F.lit(1)).alias(name))
    match_edges = edges.filter(F.col("kind") == MATCH)
    matches = match_edges.groupBy(F.col("to").alias("request")).agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("from").alias("matched_sources")
    )
    responses = count(edges.filter(F.col("kind") == RESPONSE).select(F.col("from").alias("request")), "responses")
    behind = ancestor_counts(events, edges)
    pool = events.filter(node_kind().isin("source", "transform") & (F.col("observation") != "inclusion")).groupBy(
        "session_id", "agent_id"
    ).agg(F.count(F.lit(1)).alias("candidates"))
    usage = events.filter(F.col("observation") == "usage").groupBy(
        F.sha2(F.concat_ws("/", *_null_key()), 256).alias("request_key")
    ).agg(F.count(F.lit(1)).alias("usage_rows"), F.sum("usage_output_tokens").alias("usage_output"))
    out = requests.join(matches, "request", "left").join(responses, "request", "left").join(behind, "request", "left")
    out = out.join(pool, ["session_id", "agent_id"], "left").join(usage, "request_key", "left")
    out = out.fillna(0, ["matches", "matched_sources", "responses", "ancestors", "candidates", "usage_rows"])
    return out.select(
        "session_id", "request", "matches", "responses", "ancestors", "candidates",
        (F.col("candidates") - F.col("matched_sources")).alias("unmatched"), "usage_rows", "usage_output",
        F.when(F.col("responses") > 0, "Response observed; semantic influence unknown")
        .otherwise("Output not recorded").alias("output_status"),
    )


def request_sources(events: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The candidate sources of chosen requests (request), each matched or unmatched.

    Listing is by chosen request: the output is the candidates of those requests only.
    """
    asked = events.join(chosen.select(F.col("request").alias("event_id")).distinct(), "event_id", "left_semi").select(
        F.col("event_id").alias("request"), "session_id", "agent_id")
    pool = events.filter(node_kind().isin("source", "transform") & (F.col("observation") != "inclusion")).select(
        "session_id", "agent_id", F.col("event_id").alias("id"))
    used = edges.filter(F.col("kind") == MATCH).select(
        F.col("to").alias("request"), F.col("from").alias("id"), F.lit(True).alias("matched")).distinct()
    return asked.join(pool, ["session_id", "agent_id"]).join(used, ["request", "id"], "left").select(
        "session_id", "request", "id", F.coalesce("matched", F.lit(False)).alias("matched"))
