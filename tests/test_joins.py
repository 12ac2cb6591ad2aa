"""Joins with rows for each session must not be broadcast on an estimate of their size."""

from pyspark.sql import functions as F

from rows import lines_of
from fixtures import LOOP_RUN

from tracelode.operators import compare, detectors, metrics, ordered, services
from tracelode.session import cut
from tracelode.sources import trace_formats


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def loop_stages(spark):
    return services.loop_stages(trace_formats.ingest(lines_of(spark, {f"logs/{i}/trace.jsonl": LOOP_RUN for i in "ab"})).events)


def test_carries_are_not_broadcast(spark):
    rows = cut(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "s string, n bigint"))
    out = ordered.running(rows, ["s"], ["n"], [ordered.Running("c", "count")], ordered.seq_segment("n", None, rows=2))
    assert "Broadcast" not in plan(out)
    assert sorted((r.s or "", r.n, r.c) for r in out.collect()) == [("", 3, 1), ("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def test_small_loop_sessions_are_not_cut_into_segments(spark, monkeypatch):
    seen = []
    whole = trace_formats.running
    monkeypatch.setattr(trace_formats, "running", lambda *a: seen.append(a[-1]) or whole(*a))
    events = trace_formats.ingest(lines_of(spark, {"logs/a/trace.jsonl": LOOP_RUN})).events
    assert seen == [None]
    got = {r.seq: (r.id, r.parent_id) for r in events.collect()}
    assert len(got) == len(LOOP_RUN) and got[0][1] is None and all(got[n][1] == got[n - 1][0] for n in range(1, len(got)))


def test_loop_findings_are_not_broadcast(spark):
    stages = cut(loop_stages(spark))
    for find in (services.loop_bottleneck, services.loop_gaps, services.agent_timeout):
        assert "Broadcast" not in plan(find(stages)), find.__name__
    assert {r.session_id: r.summary for r in services.loop_bottleneck(stages).collect()} == {
        s: "The generate stage consumed 90% of recorded agent time" for s in "ab"}


def test_health_joins_are_not_broadcast(spark):
    rows = [("s", 1, "a", None, "message", False), ("s", 2, "b", "gone", "tool_call", False), ("s", 3, "c", "b", "tool_result", True)]
    trace = cut(spark.createDataFrame(rows, "session_id string, seq bigint, id string, parent_id string, kind string, is_error boolean").withColumns(
        {"name": F.lit("x"), "signature": F.lit("y")}))
    dangling, errors = detectors.dangling_events(trace), detectors.unrecovered_errors(trace)
    health = metrics.health(metrics.session_metrics(trace), errors)
    for df in (dangling, errors, health, detectors.tool_calls(trace)):
        assert "Broadcast" not in plan(df)
    assert [r.id for r in dangling.collect()] == ["b"]
    assert [(r.findings, r.workflow_health < 100) for r in health.collect()] == [(1, True)]


def test_contract_findings_are_not_broadcast(spark):
    sessions = cut(spark.createDataFrame([("s", 0), ("t", 1)], "session_id string, pipeline_success int"))
    events = cut(spark.createDataFrame([("s", 1, "a", True), ("t", 1, "a", True)], "session_id string, seq bigint, id string, is_error boolean"))
    found = services.contract_findings(sessions, events)
    assert "Broadcast" not in plan(found)
    assert [(r.session_id, r.evidence) for r in found.collect()] == [("s", ["a"])]


def test_pairs_are_not_broadcast(spark):
    measured = cut(spark.createDataFrame([("1", 2), ("2", 5)], "session_id string, findings bigint"))
    pairs = cut(spark.createDataFrame([("1", "2"), ("2", "3")], "before string, after string"))
    both = compare.paired(measured, pairs)
    assert "Broadcast" not in plan(both)
    assert [(r.before, r.after, r.before_m.findings, r.after_m.findings) for r in both.collect()] == [("1", "2", 2, 5)]
