"""Golden traces: ingest, findings, health, quarantine, graph metrics."""

import json

import pytest

from rows import by_key, lines_of
from fixtures import ANSWERED, APART, LOOP_RUN, RING, UNVERIFIED, loop, pi_loop
from tracelode.operators import detectors, graph, metrics, services
from tracelode.plans import analysis
from tracelode.session import cut
from tracelode.sources import trace_formats as tf

CALL = {"id": "c1", "kind": "tool_call", "name": "bash", "arguments": {"command": "x"}, "parent_id": None}
GOOD = {
    "logs/pi.jsonl": pi_loop(),
    "run-7/trace.jsonl": LOOP_RUN,
    "logs/recovered.jsonl": [
        CALL, {"id": "r1", "kind": "tool_result", "parent_id": "c1", "is_error": True},
        {**CALL, "id": "c2", "parent_id": "r1"}, {"id": "r2", "kind": "tool_result", "parent_id": "c2", "is_error": False},
    ],
    "logs/open.jsonl": [
        CALL, {"id": "r1", "kind": "tool_result", "parent_id": "c1", "is_error": True},
        {"id": "m", "kind": "message", "role": "assistant", "content": "moving on"},
    ],
    "logs/merge.jsonl": [
        {"id": "user", "kind": "m", "parent_ids": []}, {"id": "system", "kind": "m", "parent_ids": []},
        {"id": "request", "kind": "m", "parent_ids": ["user", "system"]},
    ],
    "logs/omitted.jsonl": [{"id": "a"}, {"id": "b"}, {"id": "c", "parent_id": None}],
    "logs/dangling.jsonl": [{"id": "a", "parent_ids": []}, {"id": "b", "parent_ids": ["a", "missing"]}],
    "logs/twice.jsonl": [
        {"id": f"{k}{i}", "kind": kind, "name": "bash", "parent_id": f"c{i}" if k == "r" else None, "arguments": {"a": 1}}
        for i in range(3) for k, kind in (("c", "tool_call"), ("r", "tool_result"))
    ],
    "logs/talk.jsonl": [
        {"id": "1", "role": "user", "content": "That's WRONG, try again"}, {"id": "2", "role": "assistant", "text": "stop"},
        {"id": "3", "role": "user", "content": [{"type": "text", "text": "mail me: a@example.com"}, {"x": 1}]},
    ],
    "logs/answered.jsonl": ANSWERED, "logs/ring.jsonl": RING, "logs/apart.jsonl": APART, "logs/unverified.jsonl": UNVERIFIED,
}
BAD = {
    "bad/json.jsonl": ["{oops"],
    "bad/array.jsonl": ["[1]"],
    "bad/nan.jsonl": ['{"usage":{"x":NaN}}'],
    "bad/huge.jsonl": ['{"id":"a","usage":{"x":1e400}}'],
    "bad/twice.jsonl": [{"id": "a"}, {"id": "a"}],
    "bad/parents.jsonl": [{"id": "a", "parent_ids": ["x", "x"]}],
    "bad/first.jsonl": [{"id": "a", "parent_ids": ["x"], "parent_id": "y"}],
    "bad/relation.jsonl": [{"id": "a", "parent_ids": ["x"], "parent_relations": {"z": "made"}}],
    "bad/label.jsonl": [{"id": "a", "parent_ids": ["x"], "parent_relations": {"x": "y" * 65}}],
    "bad/loop.jsonl": [{"event": "generate", "iteration": True}],
    "bad/negative.jsonl": [{"event": "generate", "iteration": -1}],
}


@pytest.fixture(scope="module")
def ingested(spark):
    out = tf.ingest(lines_of(spark, {**GOOD, **BAD}))
    out.events = cut(out.events)
    return out


@pytest.fixture(scope="module")
def found(ingested):
    rows = analysis.findings(ingested.events).orderBy("session_id", "detector", "position").collect()
    out = {}
    for row in rows:
        out.setdefault(row["session_id"], []).append(row)
    return out


@pytest.fixture(scope="module")
def health(ingested):
    return by_key(analysis.session_health(ingested.events))


def events_of(ingested, session):
    return ingested.events.filter(ingested.events.session_id == session).orderBy("seq").collect()


def test_pi_golden(ingested, found, health):
    rows = events_of(ingested, "pi-1")
    assert [r["id"] for r in rows] == ["u1", "a1", "t1", "r1", "a2", "t2", "r2", "a3", "t3", "r3"]
    assert {r["format"] for r in rows} == {"pi-v3"}
    assert [r["parent_id"] for r in rows if r["id"] in ("t1", "r1")] == ["a1", "t1"]
    assert rows[-1]["text"] == "no; <redacted:secret>" and rows[-1]["redactions"] == ["secret"]
    assert [(f["code"], f["evidence"]) for f in found["pi-1"]] == [
        ("repeated_action", ["t1", "t2", "t3"]), ("errors", ["r1", "r2", "r3"]), ("dead_end", ["r3"]),
    ]
    assert found["pi-1"][0]["summary"] == "Repeated bash action 3 times in a short window"
    h = health["pi-1"]
    assert (h["events"], h["edges"], h["branches"], h["tool_calls"], h["workflow_health"]) == (10, 9, 0, 3, 46)
    totals = {r["counter"]: r["total"] for r in metrics.usage_totals(ingested.events).filter("session_id='pi-1'").collect()}
    assert totals == {"input": 30.0, "output": 15.0, "totalTokens": 45.0, "cacheRead": 0.0, "cacheWrite": 0.0}


def test_loop_golden(ingested, found, health):
    assert [f["code"] for f in found["run-7"]] == ["errors", "dead_end", "agent_timeout", "loop_bottleneck"]
    assert found["run-7"][3]["summary"] == "The generate stage consumed 90% of recorded agent time"
    h = health["run-7"]
    assert (h["events"], h["edges"]) == (7, 6)
    stages = services.loop_stages(ingested.events.filter("session_id='run-7'"))
    m = services.loop_metrics(stages).first()
    assert (m["loop_iterations"], m["loop_retries"], m["loop_status"]) == (3, 2, "failed")
    assert m["loop_duration_ms"] == 100_000 and m["loop_terminal_recorded"]
    assert m["loop_failure_classification_missing"] == 0
    per_stage = {r["stage"]: r["duration_ms"] for r in services.stage_durations(stages).collect()}
    assert per_stage == {"generate": 90000.0, "evaluate": 10000.0}
    session = by_key(tf.loop_sessions(ingested.events.filter("session_id='run-7'")))["run-7"]
    assert (session["iterations"], session["status"]) == (3, "failed")
    adapters = sorted(r["adapter"] for r in tf.loop_adapters(ingested.events.filter("session_id='run-7'")).collect())
    assert adapters == ["alpha", "beta"]
    assert events_of(ingested, "run-7")[3]["id"] == "iteration-002-generate-0004"


def test_recovery(found):
    assert "recovered" not in found
    (only,) = found["open"]
    assert only["code"] == "errors" and "1 unrecovered" in only["summary"]


def test_parents(ingested, found, health):
    merged = [(r["src"], r["dst"], r["relation"]) for r in graph.edges(
        ingested.events.filter("session_id='merge'")).orderBy("dst", "ordinal").collect()]
    assert merged == [("user", "request", "precedes"), ("system", "request", "precedes")]
    assert health["merge"]["merge_events"] == 1
    assert [r["parent_id"] for r in events_of(ingested, "omitted")] == [None, "a", None]
    (only,) = found["dangling"]
    assert only["code"] == "dangling_edges" and only["evidence"] == ["b"]
    assert health["dangling"]["edges"] == 2 and health["dangling"]["workflow_health"] == 97


def test_no_repeat_when_calls_succeed(found):
    assert "twice" not in found


def test_text_and_corrections(ingested, found):
    rows = events_of(ingested, "talk")
    assert rows[2]["text"] == "mail me: <redacted:email>\n"
    (only,) = found["talk"]
    assert only["code"] == "user_correction" and only["evidence"] == ["1"]


def test_quarantine(ingested):
    reasons = {r["source"]: r["reason"] for r in ingested.errors.collect()}
    assert reasons == {
        "bad/json.jsonl": "invalid_json", "bad/array.jsonl": "not_an_object", "bad/nan.jsonl": "invalid_json",
        "bad/huge.jsonl": "usage_not_finite", "bad/twice.jsonl": "duplicate_event_id",
        "bad/parents.jsonl": "malformed_parent_ids", "bad/first.jsonl": "parent_mismatch",
        "bad/relation.jsonl": "malformed_parent_relations", "bad/label.jsonl": "malformed_parent_relations",
        "bad/loop.jsonl": "malformed_loop_event", "bad/negative.jsonl": "negative_iteration",
    }
    assert ingested.events.filter("source like 'bad/%'").isEmpty()
    assert {r["session_id"] for r in ingested.sessions.collect()} == {
        "pi-1", "run-7", "recovered", "open", "merge", "omitted", "dangling", "twice", "talk", "answered", "ring",
        "apart", "unverified",
    }


def test_graph_metrics(ingested):
    wanted = ["answered", "ring", "apart", "unverified"]
    trace = ingested.events.filter(ingested.events.session_id.isin(wanted))
    m = by_key(graph.graph_metrics(trace))
    expect = {
        "declared_nodes": [7, 4, 4, 3], "implicit_nodes": [0, 1, 0, 0], "edges": [7, 5, 2, 2], "roots": [1, 0, 2, 1],
        "leaves": [2, 1, 2, 1], "weakly_connected_components": [1, 1, 2, 1], "is_dag": [True, False, True, True],
        "cycle_nodes": [0, 3, 0, 0], "max_depth": [4, None, 1, 2], "outputs": [2, 0, 1, 0],
        "reachable_outputs": [2, 0, 0, 0], "request_output_coverage": [1.0, None, 0.0, None],
        "changed_artifacts": [2, 0, 0, 1], "verified_artifacts": [1, 0, 0, 0],
        "artifact_verification_coverage": [0.5, None, None, 0.0],
    }
    for name, values in expect.items():
        assert [m[s][name] for s in wanted] == values, name
    h = by_key(analysis.session_health(trace))
    assert [(h[s]["merge_events"], h[s]["branches"]) for s in wanted] == [(1, 2), (1, 1), (0, 0), (0, 0)]
    assert [h[s]["workflow_health"] for s in wanted] == [100, 97, 100, 58]


def test_loop_variants(spark):
    files = {}
    for i, value in enumerate([None, "", "none", "unknown", " ", 42, False]):
        files[f"u{i}/t.jsonl"] = loop(
            {"event": "evaluate", "ok": False, "failureClass": value}, {"event": "finish", "status": "failed"})
    files["cut/t.jsonl"] = loop({"event": "generate", "ok": True})
    files["resumed/t.jsonl"] = loop({"event": "finish", "status": "passed"}, {"event": "generate", "ok": True})
    files["odd/t.jsonl"] = loop({"event": "finish", "status": "running"})
    stages = services.loop_stages(tf.ingest(lines_of(spark, files)).events)
    m = by_key(services.loop_metrics(stages))
    assert all(m[f"u{i}"]["loop_failure_classification_missing"] == 1 for i in range(7))
    assert all(not m[s]["loop_terminal_recorded"] for s in ("cut", "resumed", "odd"))
    codes = {(r["session_id"], r["code"]) for r in services.loop_findings(stages).collect()}
    assert {(s, "loop_incomplete") for s in ("cut", "resumed", "odd")} <= codes
    assert {(f"u{i}", "loop_telemetry_gap") for i in range(7)} <= codes
    assert not any(code == "loop_incomplete" and s.startswith("u") for s, code in codes)


def test_core_detectors_run_without_text(ingested):
    slim = ingested.events.drop("text", "role", "meta")
    assert detectors.core_findings(slim).filter("code='user_correction'").isEmpty()


def test_files_of_one_name_stay_apart(spark):
    """A name in two folders, and a copied log, are sessions of their own by source."""
    same = {f"{folder}/log.jsonl": [{"id": "a"}, {"id": "b", "kind": "tool_result", "is_error": folder == "x"}] for folder in "xy"}
    copies = {f"{folder}/pi-{folder}.jsonl": pi_loop() for folder in "xy"}
    found = tf.ingest(lines_of(spark, {**same, **copies}))
    assert {r["session_id"] for r in found.sessions.collect()} == {"log", "pi-1"}
    apart = tf.by_source(found)
    health = by_key(analysis.session_health(cut(apart.events)))
    assert set(health) == {*same, *copies}
    assert health["x/log.jsonl"]["workflow_health"] < health["y/log.jsonl"]["workflow_health"] == 100
    assert health["x/pi-x.jsonl"]["events"] == health["y/pi-y.jsonl"]["events"]
    names = {r["session_id"]: r["session_name"] for r in apart.sessions.collect()}
    assert names["x/log.jsonl"] == names["y/log.jsonl"] == "log"


def test_loop_metadata_is_cleaned_where_it_must_be(spark):
    """Plain members stay; nested ones and strings with something to redact go through the helper."""
    step = {"event": "generate", "iteration": 1}
    rows = [
        {**step, "reason": "all well", "durationMs": 1.5, "ok": True}, {**step, "reason": "mail a@example.com"},
        {**step, "checks": {"api_key": "x"}}, {**step, "reason": "password=hunter2"}, {**step, "reason": "Bearer abcdef"},
        {**step, "reason": 'a "quoted" word'}, {**step, "reason": "AKIA" + "A" * 16}, {**step, "reason": "sk-" + "a" * 16},
    ]
    events = tf.ingest(lines_of(spark, {"run/trace.jsonl": rows})).events.orderBy("seq").collect()
    assert [e["redactions"] for e in events] == [[], ["email"], ["api_key"], ["secret"], ["bearer"], [], ["aws_key"], ["openai_key"]]
    assert json.loads(events[0]["meta"]) == {"iteration": 1, "event": "generate", "reason": "all well", "durationMs": 1.5, "ok": True}
    assert json.loads(events[5]["meta"])["reason"] == 'a "quoted" word'
    assert json.loads(events[1]["meta"])["reason"] == "mail <redacted:email>"
