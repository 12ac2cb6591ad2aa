"""Ordered scans under skew, matching, provenance, reports, plans and sinks on small known inputs."""

import dataclasses
import json

import pytest
from rows import by_key, lines_of
from pyspark.sql import functions as F

import fixtures as fx
from tracelode.functions import text as tx
from tracelode.functions import variants as v
from tracelode.names import DEFAULT
from tracelode.operators import compare, detectors, graph, matching, ordered, provenance, services
from tracelode.plans import analysis, topology
from tracelode.session import cut
from tracelode.sources import adapters, context, lines, reports
from tracelode.sources import trace_formats as tf


def test_segmented_scan_equals_plain_window(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("k"), F.col("id").alias("seq"),
        F.when(F.col("id") % 13 == 0, F.col("id")).alias("mark"), (F.col("id") % 3).alias("x"),
    )
    specs = [
        ordered.Running("n", "count"), ordered.Running("s", "sum", F.col("x")),
        ordered.Running("last", "last", F.col("mark")), ordered.Running("before", "last", F.col("seq"), include_current=False),
    ]
    plain = ordered.running(rows, ["k"], ["seq"], specs, None)
    cut_up = ordered.running(rows, ["k"], ["seq"], specs, F.floor(F.col("seq") / 17))
    columns = plain.columns
    assert plain.exceptAll(cut_up.select(columns)).isEmpty() and cut_up.select(columns).exceptAll(plain).isEmpty()


def test_detectors_match_with_tiny_segments(spark, monkeypatch):
    out = tf.ingest(lines_of(spark, {"a/hot.jsonl": [
        {"id": f"{k}{i}", "kind": kind, "name": f"tool{i % 2 if i > 40 else 0}", "arguments": {"i": i % 2 if i > 40 else 0},
         "parent_id": f"c{i}" if k == "r" else None, "is_error": k == "r" and i % 5 != 4}
        for i in range(60) for k, kind in (("c", "tool_call"), ("r", "tool_result"))
    ]})).events
    whole = {f: getattr(detectors, f)(out, 10).collect() for f in ("repeated_action", "alternating_loop")}
    calls = detectors.tool_calls(out, 10)
    halo = ordered.with_halo
    monkeypatch.setattr(detectors, "with_halo", lambda df, p, r, b: halo(df, p, r, None, 9))
    for f, rows in whole.items():
        assert rows and getattr(detectors, f)(out, None, calls).collect() == rows


def test_layered_digest_sees_order(spark):
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(50)] + [("b", i, str(i)) for i in range(50)]
                                 + [("c", i, str(49 - i)) for i in range(50)], "k string, seq bigint, x string")
    d = {r["k"]: r["digest"] for r in ordered.layered_digest(rows, ["k"], "seq", F.col("x"), fan=4).collect()}
    assert d["a"] == d["b"] != d["c"]


def test_redaction_and_hygiene(spark):
    row = spark.createDataFrame(
        [("email a@example.com password=hunter2 sk-abcdefghijklmnop", "see /home/me/x and 10.0.0.1", "plain line")], "a string, b string, c string"
    ).select(
        tx.redaction_labels(F.col("a")).alias("labels"), tx.redacted(F.col("a")).alias("text"),
        tx.hygiene_labels(F.col("b")).alias("bad"), tx.hygiene_labels(F.col("c")).alias("good"),
        v.nested_clean(F.lit('{"password":"hunter2","nested":{"api-key":"abc"}}')).alias("n"),
    ).first()
    assert row["labels"] == ["secret", "openai_key", "email"] and "hunter2" not in row["text"]
    assert row["bad"] == ["absolute personal home path", "private network address"] and row["good"] == []
    assert sorted(row["n"]["labels"]) == ["api_key", "password"] and "hunter2" not in row["n"]["value"]


def docs_of(spark, bodies):
    return spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies.items()], "session_id string, body string")


def test_contract_reports(spark):
    failed, wrong, order = fx.contract(), fx.contract(), fx.contract()
    failed["stages"][1]["checks"][0]["passed"] = False
    wrong["fixture_sha256"] = "A" * 64
    order["stages"].reverse()
    out = reports.ingest_contract(docs_of(spark, {
        "ok": fx.contract(), "failed": failed, "bare": fx.contract("uploaded"), "wrong": wrong, "order": order}))
    m = by_key(out.sessions)
    assert (m["ok"]["pipeline_success"], m["ok"]["pipeline_checks_passed"], m["ok"]["pipeline_duration_ms"]) == (1, 3, 24)
    assert (m["failed"]["pipeline_success"], m["failed"]["pipeline_checks_failed"]) == (0, 1)
    assert (m["bare"]["pipeline_checks_required"], m["bare"]["pipeline_checks_missing"]) == (3, 1)
    assert {r["source"]: r["reason"] for r in out.errors.collect()} == {"wrong": "malformed_digest", "order": "stage_order"}
    found = by_key(services.contract_findings(out.sessions, out.events))
    assert set(found) == {"failed", "bare"} and found["failed"]["evidence"][-1] == "result"
    assert out.events.filter("session_id='ok'").count() == 8


def test_retrieval_and_memory_reports(spark):
    out = reports.ingest_retrieval(docs_of(spark, {"good": fx.retrieval(), "bad": fx.retrieval(False)}))
    m = by_key(out.sessions)
    assert (m["good"]["retrieval_attempts"], m["good"]["retrieval_unsuccessful_attempts"], m["good"]["retrieval_elapsed_s"]) == (3, 2, 5.5)
    assert [r["session_id"] for r in services.escalation_deferred(out.sessions).collect()] == ["bad"]
    assert out.events.filter("session_id='good'").count() == 5
    mem = reports.ingest_memory(docs_of(spark, {"base": fx.memory(), "empty": fx.memory(40, 4, 0)}))
    codes = {(r["session_id"], r["code"]) for r in services.memory_findings(mem.sessions).collect()}
    assert codes == {("base", "high_abstain_rate"), ("empty", "empty_memory_catalog")}
    assert by_key(mem.sessions)["base"]["turn_abstain_rate"] == 0.5
    assert mem.events.filter("session_id='base'").count() == 4


def test_health_of_report_formats(spark):
    broken = fx.contract()
    broken["stages"][2]["checks"][0]["passed"] = False
    rows = by_key(analysis.format_health(
        contract=reports.ingest_contract(docs_of(spark, {"c-good": fx.contract(), "c-bad": broken})),
        retrieval=reports.ingest_retrieval(docs_of(spark, {"r-good": fx.retrieval(), "r-bad": fx.retrieval(False)})),
        memory=reports.ingest_memory(docs_of(spark, {"m": fx.memory()}))))
    assert {k: r["workflow_health"] for k, r in rows.items()}["c-bad"] == 28
    assert (rows["r-bad"]["workflow_health"], rows["m"]["workflow_health"], rows["c-good"]["workflow_health"]) == (46, 88, 100)


@pytest.mark.parametrize("found,primary,guards,phases,nodes", [
    ([("pipeline_contract", "critical"), ("dead_end", "warning"), ("agent_timeout", "warning"), ("repeated_action", "warning")],
     "pipeline_contract", ["dead_end", "repeated_action"],
     "check-contract,repair-producer,verify-artifacts,bounded-retry,retry-with-new-hypothesis,handoff",
     "Start → CheckContract → RepairProducer → RetryBudget(2) → VerifyArtifacts → Handoff → Done"),
    ([("repeated_action", "warning"), ("errors", "warning")], "errors", ["repeated_action"],
     "classify-then-act,bounded-retry,retry-with-new-hypothesis",
     "Start → ClassifyFailure → Act → RetryBudget(2) → Verify → Done"),
    ([("agent_timeout", "critical"), ("dangling_edges", "info")], "agent_timeout", ["dangling_edges"], "parallel-work,fallback",
     "Start → ParallelWork → FallbackAdapter → Verify → Done"),
    ([("alternating_loop", "warning"), ("user_correction", "warning")], "alternating_loop", ["user_correction"],
     "preflight,checkpoint,strategy-fork", "PreflightChecklist → Start → Act → Summarize → PickStrategy → Verify → Done"),
])
def test_topology_goldens(spark, found, primary, guards, phases, nodes):
    rows = spark.createDataFrame([("s", 1, i, c, s, "", []) for i, (c, s) in enumerate(found)],
                                 "session_id string, detector int, position bigint, code string, severity string, summary string, evidence array<string>")
    plan = topology.topology_plan(rows.select("session_id").distinct(), rows).first()
    assert (plan["primary_finding"], plan["guard_codes"], ",".join(plan["phases"]), plan["node_sequence"]) == (primary, guards, phases, nodes)


def test_scorecard_gates(spark):
    m = spark.createDataFrame([("a", 10, 3, 0, 2, 46), ("b", 8, 2, 0, 0, 88)],
                              "session_id string, events int, tool_calls int, branches int, findings int, workflow_health int")
    f = spark.createDataFrame([("a", "errors", "warning"), ("a", "dead_end", "critical")], "session_id string, code string, severity string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "before string, after string")
    out = by_key(compare.scorecard(m, f, pairs), "before")
    assert out["a"]["ok"] and out["a"]["health_delta"] == 42
    assert out["b"]["failed_gates"] == ["workflow_health_delta", "finding_delta", "no_new_critical_findings"]


def test_incomparable_pair_never_passes(spark):
    m = spark.createDataFrame(
        [("a", "contract", "1", 3, 46), ("b", "contract", "2", 0, 99)], "session_id string, format string, d string, findings int, workflow_health int"
    ).select("*", F.col("d").alias("fixture_sha256"), F.lit("v").alias("verifier_sha256"), F.lit("c").alias("contract_sha256"))
    names = dataclasses.replace(DEFAULT, contract_format="contract")
    f = spark.createDataFrame([], "session_id string, code string, severity string")
    row = compare.scorecard(m, f, spark.createDataFrame([("a", "b")], "before string, after string"), names=names).first()
    assert (row["refused"], row["ok"], row["failed_gates"]) == ("fixture_sha256_mismatch", False, [])


def test_rows_without_position_stay(spark):
    rows = spark.createDataFrame([("s", 1, 1), ("s", 7, 1), ("s", None, 1), (None, 2, 1)], "session_id string, seq long, x int")
    for segment in (None, ordered.seq_segment("seq", None, 3)):
        got = ordered.running(rows, ["session_id"], ["seq"], [ordered.Running("n", "count"), ordered.Running("t", "sum", F.col("x"))], segment)
        assert sorted((r.seq or 0, r.n, r.t) for r in got.collect()) == [(0, 1, 1), (1, 2, 2), (2, 1, 1), (7, 3, 3)]
    haloed = ordered.with_halo(rows, "seq", 1, None, 2)
    assert haloed.filter("not _halo").count() == 4


def test_nothing_is_capped(spark):
    turn = "session_id string, request_id string, seq long, event_id string, "
    long_text = "x" * 140_000
    sources = spark.createDataFrame([("s", "r", 1, "a", "ab"), ("s", "r", 2, "b", long_text)], turn + "text string")
    parts = [{"type": "text", "text": "ab " * 10} for _ in range(20)] + [{"type": "text", "text": long_text}]
    body = json.dumps({"messages": [{"role": "user", "content": parts}]})
    payloads = spark.createDataFrame([("s", "r", 3, "p", body)], turn + "payload string")
    got = matching.text_matches(sources, payloads).groupBy("source_id").count().collect()
    assert {r["source_id"]: r["count"] for r in got} == {"a": 200, "b": 1}
    assert matching.source_health(sources).isEmpty() and matching.payload_health(payloads).isEmpty()


def test_long_rollout_is_read_whole(spark):
    line = json.dumps({"type": "turn_context", "payload": {}})
    said = json.dumps({"type": "response_item", "payload": {"role": "user", "content": "hi"}})
    rows = spark.range(60_001).select(
        F.lit("s").alias("session_id"), F.col("id").alias("ordinal"), F.when(F.col("id") == 60_000, said).otherwise(line).alias("line"))
    got = adapters.codex_rollout(rows, "key").filter("observation = 'prompt' or boundary like '%user%' or source_category = 'user_input'")
    assert got.count() == 1


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.jsonl").write_text('{"id": 1}\n\n  \n{"id": 2}\r\n{"id": 3}')
    (tmp_path / "two.jsonl").write_bytes(b'{"id": "\xff"}\n{"id": 2}\n')
    (tmp_path / "blank.jsonl").write_text("\n \n")
    (tmp_path / "big.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found, errors = lines.scan_files(spark, str(tmp_path))
        rows = found.select(F.element_at(F.split("source", "/"), -1).alias("f"), "line_no", "ordinal", F.trim("line").alias("line")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.ordinal) for r in rows if r.f == "one.jsonl") == [(1, 0), (4, 1), (5, 2)]
    big = sorted((r.line_no, r.ordinal, r.line) for r in rows if r.f == "big.jsonl")
    assert big == [(i + 1, i, f'{{"id": {i}}}') for i in range(40_000)]
    assert sorted((r.source.split("/")[-1], r.reason) for r in errors.collect()) == [
        ("blank.jsonl", "empty_session"), ("two.jsonl", "invalid_utf8")]


def test_exact_spans_and_containment(spark):
    row = spark.createDataFrame([("é café", "café"), ("a.b.a", "."), ("aaaa", "aa")], "t string, s string")
    spans = [[(x["start"], x["end"]) for x in r["spans"]] for r in row.select(matching.byte_spans(F.col("t"), F.col("s")).alias("spans")).collect()]
    assert spans == [[(3, 8)], [(1, 2), (3, 4)], [(0, 2), (2, 4)]]
    texts = ["one two three four five six seven", "zzone two three four five six sevenzz tail", "no match here", "tiny x tiny"]
    sources = ["one two three four five six seven", "tiny", "three four five six", "absent words never seen in any text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([*enumerate(sources), (9, sources[0])], "item_id bigint, text string")
    got = sorted((r["item_id"], r["doc_id"], r["start"]) for r in matching.containment(docs, items).collect())
    want = sorted((i, d, p) for i, s in [*enumerate(sources), (9, sources[0])] for d, t in enumerate(texts)
                  for p in range(len(t)) if t.startswith(s, p))
    assert got == want


def test_short_sources(spark):
    """Sources shorter and longer than a run of characters, with wide letters, blanks and repeats, in one pass of runs."""
    texts = ["tiny x tiny", "a", "", None, "caf\u00e9 \U0001F600 ok", "xx  yy", "aaaaaaa", "short tail end"]
    sources = ["tiny", "a", " ", "caf\u00e9", "\U0001F600 o", "xx  yy", "aaa", "tail end", "end", "absent", "tail ends", "", None, "aaaaaa", "x ti"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([*enumerate(sources), (99, "tiny"), (0, "tail end")], "item_id bigint, text string")
    got = sorted((r["item_id"], r["doc_id"], r["start"]) for r in matching.containment(docs, items).collect())
    want = []
    for i, s in [*enumerate(sources), (99, "tiny"), (0, "tail end")]:
        for d, t in enumerate(texts):
            at = (t or "").find(s) if s else -1
            while at >= 0:
                want.append((i, d, len(t[:at].encode())))
                at = t.find(s, at + len(s))
    assert got == sorted(want)


def rows_read(df):
    """Rows the scan of a plan gave out, after running it."""
    n = len(df.collect())
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return n, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_by_key_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("s"), "id")
    events = context.build(rows, {
        "session_id": F.col("s"), "producer_seq": F.col("id"), "event_id": F.sha2(F.concat(F.lit("e"), "id"), 256),
        "source_key": F.sha2(F.concat(F.lit("k"), (F.col("id") / 2).cast("long")), 256)})
    path = str(tmp_path / "index")
    assert context.write_index(events, path, buckets=16, files_per_bucket=4) == 20_000
    one = events.filter("producer_seq = 777").select("event_id", "source_key").first()
    found, read = rows_read(context.lookup(spark, path, "event_id", one["event_id"]))
    assert found == 1 and read < 20_000 / 8
    found, read = rows_read(context.lookup(spark, path, "source_key", one["source_key"]))
    assert found == 2 and read < 20_000 / 8
    found, read = rows_read(context.lookup(spark, path, "event_id", "none such"))
    assert found == 0 and read < 20_000 / 8
    with pytest.raises(ValueError):
        context.lookup(spark, path, "wall_time", "x")


def capture(spark):
    """Two requests: matched prompt and system text, a summary, a missing parent, an unobserved output."""
    rec = lambda i, seq, req, kind, **body: ("s", seq, i, f"w{seq}", req, None, kind, json.dumps(body))
    ask, rule = "why four?", "only the sample"
    payload = {"messages": [{"role": "system", "content": rule}, {"role": "user", "content": [{"type": "text", "text": ask}]}], "meta": rule}
    rows = [
        rec("u", 1, "r1", "prompt", text=ask), rec("y", 2, "r1", "system_prompt", text=rule), rec("t", 3, "r1", "prompt", text=ask),
        rec("p", 4, "r1", "payload", payload=payload, provisional=True),
        rec("a", 5, "r1", "response", text="so", payloadEventId="p"), rec("x", 6, "r1", "extension", name="ext"),
        rec("m", 7, "r2", "compaction", text="sum", ancestorEventIds=["u", "y"]),
        rec("q", 8, "r2", "payload", payload={"messages": []}, final=True),
        rec("b", 9, "r2", "response", text="t", payloadEventId="gone"), rec("g", 10, "r2", "gap", boundary="loss", droppedEvents=2),
    ]
    return spark.createDataFrame(rows, "session_id string, seq bigint, event_id string, wall_time string, request_id string, attempt_id string, type string, body string")


def test_provenance_graph(spark):
    records = capture(spark)
    base = ["session_id", "request_id", "seq", "event_id"]
    sources = records.filter("type in ('prompt', 'system_prompt')").select(*base, F.get_json_object("body", "$.text").alias("text"))
    payloads = records.filter("type = 'payload'").select(*base, F.get_json_object("body", "$.payload").alias("payload"))
    events = adapters.pi_host_events(records, "key")
    assert context.rejected(events).isEmpty()
    found = matching.text_matches(sources, payloads)
    assert {(r["source_id"], r["pointer"]) for r in found.collect()} == {
        ("u", "/messages/1/content/0/text"), ("t", "/messages/1/content/0/text"), ("y", "/messages/0/content")}
    whole = cut(events.unionByName(matching.inclusions(found, events)))
    edges = {(r["from"], r["to"], r["kind"], r["ambiguous"]) for r in provenance.prov_edges(whole).collect()}
    assert edges == {
        ("u", "p", "observed_text_match", True), ("t", "p", "observed_text_match", True), ("y", "p", "observed_text_match", False),
        ("p", "a", "response_to", False), ("u", "m", "summary_ancestor", False), ("y", "m", "summary_ancestor", False)}
    issues = [r["code"] for r in provenance.prov_issues(whole).collect()]
    assert issues.count("missing_parent") == 1 and issues.count("ambiguous_match") == 2 and "cycle" not in issues
    seen = by_key(provenance.request_inspection(whole), "request")
    assert (seen["p"]["matches"], seen["p"]["responses"], seen["q"]["matches"]) == (3, 1, 0)
    assert seen["q"]["output_status"] == "Output not recorded"


def test_tool_span(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in adapters.tool_span(
        F.lit("read"), F.parse_json(F.lit('{"path":"/a.py","offset":10,"limit":20}'))).items()]).first()
    assert (row["range"]["start"], row["range"]["end"], row["match_method"], row["coverage"]) == (10, 29, "runtime_line_range", "full")


def test_file_scan(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.jsonl").write_text('{"id":"x"}\n\n  \n{"id":"y"}\n')
    (tmp_path / "b.jsonl").write_bytes(b"\xff\xfe{}\n")
    (tmp_path / "c.txt").write_text("{}")
    raw, errors = lines.scan_files(spark, str(tmp_path))
    assert [(r["line_no"], r["ordinal"]) for r in raw.orderBy("ordinal").collect()] == [(1, 0), (4, 1)]
    assert [r["reason"] for r in errors.collect()] == ["invalid_utf8"]


def test_graph_cycles_with_tails(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("l", "l"), ("m", "n"), ("q", "n"), ("n", "o"), ("o", "n")]
    e = spark.createDataFrame([("s", a, b, "precedes") for a, b in pairs], "session_id string, src string, dst string, relation string")
    n = e.select("session_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns(
        {"kind": F.lit("k"), "role": F.lit(None).cast("string")})
    g = graph.contract(e, n)
    assert {r["id"] for r in graph.cycle_nodes(g).collect()} == {"a", "b", "c", "l", "n", "o"}
    assert len({r["component"] for r in graph.components(g).collect()}) == 3


def test_segments_go_by_counted_rows(spark, monkeypatch):
    """Positions 2^20 apart, and a session with most of the rows: about as many segments as rows need, and right numbers."""
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 1000)
    monkeypatch.setattr(detectors, "SEGMENT_ROWS", 1000)
    rows = spark.range(10_000).select(
        F.when(F.col("id") < 9000, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("session_id"),
        (F.col("id") * (1 << 20)).alias("seq"), F.lit("tool_call").alias("kind"), F.col("id").cast("string").alias("id"),
        F.lit("t").alias("name"), F.lit("x").alias("signature"), F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("is_error"))
    dealt, segment = ordered.by_count(rows, ["session_id"], ["seq"])
    sizes = [r["n"] for r in dealt.groupBy("session_id", segment.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) <= 20 and max(sizes) <= 2000 and sum(sizes) == 10_000
    numbered = detectors.tool_calls(rows)
    expected = rows.selectExpr("id", "row_number() over (partition by session_id order by seq) AS call_no")
    assert numbered.select("id", "call_no").exceptAll(expected).isEmpty() and numbered.count() == 10_000


def test_unusable_captures_are_refused_whole(spark):
    from tracelode.catalog import queries

    events, rejects = context.scan(spark, queries._spoiled_log(spark, "/root/testdata/sf0.001"))
    assert {r["reason"] for r in rejects.select("reason").distinct().collect()} <= {"wrong_schema", "missing_field", "malformed_row"}
    found = provenance.provenance(events)
    refused = {r["session_id"]: r["reason"] for r in found.refused.collect()}
    assert set(refused.values()) == {"repeated_event_id", "unknown_observation"}
    for part in (found.nodes, found.edges, found.issues):
        assert not {r["session_id"] for r in part.select("session_id").distinct().collect()} & set(refused)
    assert found.nodes.count()
