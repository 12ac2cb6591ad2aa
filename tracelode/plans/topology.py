"""Ranked workflow-topology plans from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.ordered import first_rows

_RULE_SCHEMA = (
    "code string, role string, nodes array<string>, phases array<string>, flags array<string>, priority int"
)


def rule_table(spark: SparkSession) -> DataFrame:
    """The fixed rule rows: a dimension of seventeen rows."""
    rows = [
        (code, role, list(nodes), list(phases), list(flags), fv.SPINE_PRIORITY.get(code, fv.DEFAULT_PRIORITY))
        for code, (role, nodes, phases, flags) in fv.TOPOLOGY_RULES.items()
    ]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def ranked_findings(findings: DataFrame, max_findings: int = 3) -> DataFrame:
    """Best findings per session by severity, spine priority and code, with their rules.

    The rule side is the fixed seventeen-row table, so broadcasting it is bounded by construction.
    """
    severity = F.create_map(*[F.lit(x) for pair in fv.SEVERITY_RANK.items() for x in pair])
    mapped = findings.join(F.broadcast(rule_table(findings.sparkSession)), "code").withColumn(
        "severity_rank", F.coalesce(severity[F.col("severity")], F.lit(9))
    )
    order = ["severity_rank", "priority", "code", "detector", "position"]
    return first_rows(mapped, ["session_id"], order, max_findings).withColumnRenamed("_rank", "rank")


def _spot(nodes: Column, name: str) -> Column:
    """1-based position of a node, null when it is not there."""
    return F.nullif(F.array_position(nodes, F.lit(name)).cast("int"), F.lit(0))


# Insertions a guard can ask for, in the order they apply, with the node each one adds.
_INSERTIONS = {
    "preflight": "PreflightChecklist", "escalation": "EscalationGate", "handoff": "Handoff",
    "classify": "ClassifyFailure", "retry": "RetryBudget(2)",
}


def _insert(nodes: Column, action: Column) -> Column:
    """One insertion into a node sequence; nothing happens when the node is there already."""
    node = F.element_at(F.create_map(*[F.lit(x) for pair in _INSERTIONS.items() for x in pair]), action)
    end = F.size(nodes) + 1
    before_done = F.coalesce(_spot(nodes, "Done"), end)
    # Without an Act node the classifier follows Start, and Start takes the first place.
    restart = (action == "classify") & _spot(nodes, "Act").isNull() & _spot(nodes, "Start").isNotNull()
    base = F.when(restart, F.concat(F.array(F.lit("Start")), F.slice(nodes, F.lit(2), F.size(nodes)))).otherwise(nodes)
    at = (
        F.when(action == "preflight", F.lit(1)).when(action.isin("escalation", "handoff"), before_done)
        .when(restart, F.lit(2)).when(action == "classify", F.coalesce(_spot(nodes, "Act"), F.lit(1)))
        .otherwise(F.coalesce(_spot(nodes, "Verify"), _spot(nodes, "VerifyArtifacts"), before_done))
    )
    placed = F.concat(F.slice(base, F.lit(1), at - 1), F.array(node), F.slice(base, at, F.size(base)))
    return F.when(F.array_contains(nodes, node), nodes).otherwise(placed)


def _sequence(guards: Column, start: Column) -> Column:
    """Node sequence after every guard, in rank order."""
    wanted = F.flatten(F.transform(guards, lambda g: F.filter(
        F.array(*[F.lit(a) for a in _INSERTIONS]), lambda a: F.array_contains(g["flags"], a)
    )))
    return F.aggregate(wanted, start, _insert)


def topology_plan(
    sessions: DataFrame, findings: DataFrame, max_findings: int = 3, include_healthy: bool = False
) -> DataFrame:
    """Plan per session: primary, guards, flags, phases, node sequence and digest."""
    picked = ranked_findings(findings, max_findings)
    entry = F.struct("rank", "code", "role", "nodes", "phases", "flags")
    # At most ``max_findings`` rows per session reach this list.
    listed = picked.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("picked"))
    strings = "array<string>"
    role, nodes, phases, flags = fv.HEALTHY_RULE
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(strings)
    healthy = F.struct(
        F.lit("healthy").alias("code"), lits(nodes).alias("nodes"), lits(phases).alias("phases"), lits(flags).alias("flags")
    )
    joined = sessions.select("session_id").join(listed, "session_id", "left")
    none = F.col("picked").isNull()
    spine = F.get(F.filter("picked", lambda p: p["role"] == "spine"), F.lit(0))
    chosen = F.coalesce(spine, F.get("picked", F.lit(0)))
    primary = F.when(none, healthy).otherwise(F.struct(
        chosen["code"].alias("code"), chosen["nodes"].alias("nodes"), chosen["phases"].alias("phases"),
        chosen["flags"].alias("flags"),
    ))
    based = joined.withColumn("primary", primary)
    guards = F.coalesce(
        F.filter("picked", lambda p: p["code"] != F.col("primary.code")),
        F.array().cast(picked.select(F.array(entry)).schema[0].dataType),
    )
    staged = based.withColumn("guards", guards).withColumn(
        "active", F.array_distinct(F.concat("primary.flags", F.flatten(F.transform("guards", lambda g: g["flags"]))))
    )
    on = lambda flag: F.array_contains("active", flag)
    opt = lambda test, *titles: F.when(test, lits(titles)).otherwise(lits(()))
    lead = F.concat(
        opt(on("preflight"), "preflight"), opt(on("classify"), "classify-then-act"), opt(on("checkpoint"), "checkpoint")
    )
    retry = ("bounded-retry", "retry-with-new-hypothesis")
    own = F.col("primary.phases")
    body = (
        F.when(F.col("primary.code") == "pipeline_contract", F.concat(
            own, opt(on("retry") & ~F.array_contains("primary.flags", "retry"), *retry)))
        .when(on("fast"), lits(("fast-pass", "escalate")))
        .when(on("fallback"), lits(("parallel-work", "fallback")))
        .when(on("retry"), lits(retry))
        .when(F.col("primary.code") == "healthy", own)
        .when((F.size(own) == 0) & (F.size(lead) == 0), lits(("act",)))
        .otherwise(own)
    )
    tail = F.concat(opt(on("escalation"), "browser-escalation"), opt(on("handoff"), "handoff"))
    start = F.when(F.size("primary.nodes") > 0, F.col("primary.nodes")).otherwise(lits(nodes))
    sequence = _sequence(F.col("guards"), start)
    skipped = none & F.lit(not include_healthy)
    shown = lambda c: F.when(~skipped, c)
    plan = staged.select(
        "session_id", skipped.alias("skipped"),
        F.when(~none, F.col("primary.code")).alias("primary_finding"),
        F.coalesce(F.transform("picked", lambda p: p["code"]), lits(())).alias("findings_used"),
        F.transform("guards", lambda g: g["code"]).alias("guard_codes"),
        shown(F.filter(lits(fv.PLAN_FLAGS), lambda f: F.array_contains(F.col("active"), f))).alias("flags"),
        F.coalesce(shown(F.array_distinct(F.concat(lead, body, tail))), lits(())).alias("phases"),
        shown(F.array_join(sequence, " → ")).alias("node_sequence"),
    )
    snapshot = F.to_json(F.struct(
        "findings_used", "flags", "guard_codes", F.lit(fv.MAPPING_VERSION).alias("mapping_version"), "node_sequence",
        "phases", "primary_finding", "skipped",
    ), {"ignoreNullFields": "false"})
    return plan.withColumn("digest", F.sha2(snapshot, 256))
