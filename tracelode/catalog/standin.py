"""Deterministic views that turn the driver's tables into session traces.

They are test inputs for the operators, not claims about the data.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import Running, largest_group, running, seq_segment, time_segment
from ..session import cut, tune

KEY = "standin-key"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as trace events: one session per user, ordered by (ts, event_id)."""
    ev = table(spark, sf, "events")
    kind = (
        F.when(F.col("event_type") == "click", "tool_call")
        .when(F.col("event_type").isin("purchase", "error"), "tool_result").otherwise("message")
    )
    call = F.col("event_type") == "click"
    name = F.concat(F.lit("tool"), (F.get_json_object("props", "$.k").cast("bigint") % 2).cast("string"))
    rows = ev.select(
        _str("user_id").alias("session_id"), "ts", "event_id", _str("event_id").alias("id"), kind.alias("kind"),
        F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "signup", "assistant").alias("role"),
        F.when(call, name).alias("name"), (F.col("event_type") == "error").alias("is_error"),
        F.col("value"), F.when(call, tx.digest16(F.lit("tool_call"), name)).otherwise("").alias("signature"),
    )
    chained = running(
        rows, ["session_id"], ["ts", "event_id"],
        [
            Running("seq", "count"),
            Running("previous", "last", F.col("id"), include_current=False),
            Running("last_call", "last", F.when(F.col("kind") == "tool_call", F.col("id")), include_current=False),
        ],
        time_segment(ev.withColumnRenamed("user_id", "session_id"), "ts", "session_id"),
    )
    parent = F.when(F.col("kind") == "tool_result", F.coalesce("last_call", "previous")).otherwise(F.col("previous"))
    return chained.select(
        "session_id", "seq", "id", parent.alias("parent_id"), "kind", "role", "name", "is_error", "signature",
        F.create_map(F.lit("value"), F.col("value")).alias("usage"),
    )


def stored_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The trace as a table, for jobs that read it several times."""
    return cut(trace(spark, sf))


def gapped_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The trace with every tenth event removed, so some parents are absent."""
    return trace(spark, sf).filter(F.col("id").cast("bigint") % 10 != 0)


# --- raw logs ---------------------------------------------------------------


def _json(*columns: Column, nulls: bool = False) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"} if nulls else {})


def _numbered_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """Give raw lines (source, line, order columns) their ordinal in the source."""
    biggest = largest_group(rows, "source")
    numbered = running(
        rows, ["source"], order, [Running("line_no", "count")], seq_segment(order[0], biggest)
    )
    return numbered.select("source", "line_no", (F.col("line_no") - 1).alias("ordinal"), "line")


def generic_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The trace as generic JSON lines; every third event leaves its parent out."""
    t = trace(spark, sf)
    call = F.col("kind") == "tool_call"
    k = F.substring("name", 5, 1).cast("int")
    fields = [
        F.col("id"), F.col("kind"), F.col("role"), F.col("name"),
        F.format_string("value %s noted", F.col("usage.value").cast("string")).alias("content"),
        F.col("is_error"), F.col("usage"),
    ]
    args = F.struct(k.alias("k")).alias("arguments")
    omitted = F.col("id").cast("bigint") % 3 == 0
    line = (
        F.when(omitted & call, _json(*fields, args)).when(omitted, _json(*fields))
        .when(call, _json(*fields, args, F.col("parent_id"), nulls=True))
        .otherwise(_json(*fields, F.col("parent_id"), nulls=True))
    )
    return t.select(
        F.concat(F.lit("logs/user-"), "session_id", F.lit(".jsonl")).alias("source"), F.col("seq").alias("line_no"),
        (F.col("seq") - 1).alias("ordinal"), line.alias("line"),
    )


def same_name_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The generic logs, each in a folder of its own under one file name."""
    return generic_lines(spark, sf).withColumn("source", F.regexp_replace("source", r"\.jsonl$", "/trace.jsonl"))


def pi_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as message logs: a header, messages, tool calls and their results."""
    c = table(spark, sf, "conversations")
    turn, conv = _str("turn"), _str("conv_id")
    mid = F.concat(F.lit("m"), conv, F.lit("-"), turn)
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("m"), conv, F.lit("-"), (F.col("turn") - 1).cast("string")))
    call = F.concat(F.lit("t"), conv, F.lit("-"), turn)
    text_part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    header = _json(
        F.lit("session").alias("type"), F.lit(3).alias("version"), F.concat(F.lit("conv-"), conv).alias("id"),
        F.lit("/work").alias("cwd"),
    )

    def message(ident: Column, up: Column, *body: Column) -> Column:
        return _json(
            F.lit("message").alias("type"), ident.alias("id"), up.alias("parentId"), turn.alias("timestamp"),
            F.struct(*body).alias("message"), nulls=True,
        )

    tool_part = F.struct(
        F.lit("toolCall").alias("type"), call.alias("id"), F.lit("lookup").alias("name"),
        F.struct(F.col("turn").alias("n"), F.lit("abc").alias("token")).alias("arguments"),
    )
    usage = F.struct(F.col("turn").alias("output"), F.lit(True).alias("ok"), F.struct(F.lit(1).alias("t")).alias("cost"))
    said = message(mid, parent, F.col("role"), F.array(text_part).alias("content"))
    # Content parts differ in shape, so the message body is joined from their JSON.
    answered = _json(
        F.lit("message").alias("type"), mid.alias("id"), parent.alias("parentId"), turn.alias("timestamp"), nulls=True
    )
    body = F.concat(
        F.lit('{"role":"assistant","stopReason":"toolUse","usage":'), F.to_json(usage), F.lit(',"content":['),
        F.to_json(text_part), F.lit(","), F.to_json(tool_part), F.lit("]}"),
    )
    answered = F.concat(F.regexp_replace(answered, r"\}$", ""), F.lit(',"message":'), body, F.lit("}"))
    result = message(
        F.concat(F.lit("q"), conv, F.lit("-"), turn), mid, F.lit("toolResult").alias("role"), call.alias("toolCallId"),
        F.lit("lookup").alias("toolName"), (F.col("conv_id") % 3 == 0).alias("isError"),
        F.concat(F.lit("done "), turn).alias("content"),
    )
    none = F.lit(None).cast("string")
    answer = F.col("role") == "assistant"
    slots = F.array(
        F.when(F.col("turn") == 0, header).otherwise(none), F.when(answer, answered).otherwise(said),
        F.when(answer, result).otherwise(none),
    )
    rows = c.select(
        F.concat(F.lit("logs/conv-"), conv, F.lit(".jsonl")).alias("source"), "turn", F.posexplode(slots).alias("k", "line")
    ).filter(F.col("line").isNotNull())
    return _numbered_lines(rows, ["turn", "k"])


def loop_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as improvement-loop logs: one session per order."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    event = (
        F.when(n.isin(1, 4), "generate").when(n.isin(2, 5), "evaluate").when(n == 3, "validate")
        .when(n == 6, "decision").otherwise("finish")
    )
    returned = F.col("l_returnflag") == "R"
    line = _json(
        F.col("l_shipdate").cast("string").alias("ts"), event.alias("event"), (1 + F.floor(n / 4)).cast("int").alias("iteration"),
        F.when(event.isin("generate", "evaluate"), F.concat(F.lit("adapter"), (F.col("l_suppkey") % 3).cast("string"))).alias("adapter"),
        F.when(event.isin("generate", "evaluate"), ~returned).alias("ok"),
        F.when(returned & (F.col("l_linestatus") == "O"), "timeout").alias("failureClass"),
        F.when(n < 6, F.floor("l_extendedprice")).alias("durationMs"),
        F.when(n == 6, F.when(F.col("l_quantity") > 25, "retry").otherwise("stop")).alias("action"),
        F.when(n == 7, F.when(F.col("l_returnflag") == "A", "passed").when(returned, "running").otherwise("stopped")).alias("status"),
    )
    rows = li.select(
        F.concat(F.lit("loops/order-"), _str("l_orderkey"), F.lit("/trace.jsonl")).alias("source"), "l_linenumber",
        "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line"),
    )
    return _numbered_lines(rows, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def faulty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as generic lines, some of them unusable on purpose."""
    d = table(spark, sf, "documents")
    case = F.col("doc_id") % 53
    line = (
        F.when(case == 0, F.lit("{broken")).when(case == 1, F.lit("[1]"))
        .when(case == 2, F.lit('{"id":"inf","usage":{"v":1e400}}'))
        .when(case == 3, F.lit('{"id":"par","parent_ids":["x","x"]}'))
        .when(case == 4, F.lit('{"id":"dup"}'))
        .otherwise(_json(_str("doc_id").alias("id"), F.col("text").alias("content")))
    )
    rows = d.select(
        F.concat(F.lit("docs/"), "source", F.lit("-"), (F.col("doc_id") % 40).cast("string"), F.lit(".jsonl")).alias("source"),
        "doc_id", line.alias("line"),
    )
    return _numbered_lines(rows, ["doc_id"])


# --- reports ----------------------------------------------------------------


def retrieval_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One retrieval report per order."""
    o = table(spark, sf, "orders")
    spots = F.sequence(F.lit(1).cast("bigint"), 1 + F.col("o_orderkey") % 4)
    step = lambda i: (F.col("o_orderkey") + i) % 3
    attempts = F.transform(spots, lambda i: F.struct(
        F.lit("curl").alias("executor"),
        F.when(step(i) == 0, "strong_ok").when(step(i) == 1, "weak_ok").otherwise("blocked").alias("verdict"),
        F.when(F.col("o_orderkey") % 89 == 0, F.lit(-1.0)).otherwise(i * 0.5).alias("elapsed_s"),
    ))
    engine = F.struct(
        (F.col("o_orderstatus") != "F").alias("ok"), (F.col("o_orderstatus") == "P").alias("must_invoke_playwright_mcp"),
        attempts.alias("trace"),
    )
    return o.select(_str("o_orderkey").alias("session_id"), _json(engine.alias("engine")).alias("body"))


def contract_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One delivery record per order."""
    # Records lie in many files; the driver's table may be one, which a single task would make and parse.
    o = table(spark, sf, "orders").repartition(spark.sparkContext.defaultParallelism)
    key = F.col("o_orderkey")
    digest = lambda c: F.repeat(F.lit(c), 64)
    check = lambda name, ok: F.struct(F.lit(name).alias("id"), ok.alias("passed"), digest("d").alias("evidence_sha256"))
    stage = lambda name, status, ms, checks: F.struct(
        F.lit(name).alias("id"), status.alias("status"), ms.alias("duration_ms"), checks.alias("checks"))
    none = F.array().cast("array<struct<id:string,passed:boolean,evidence_sha256:string>>")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "timeout").otherwise("completed")
    ship = stage("ship", F.lit("completed"), F.lit(5), F.when(key % 5 != 0, F.array(check("sent", F.lit(True)))).otherwise(none))
    stages = F.concat(
        F.array(stage("make", F.lit("completed"), F.lit(10), F.array(check("built", F.lit(True))))),
        F.array(stage("check", status, (key % 100).cast("int"), F.array(check("tested", key % 4 != 0)))),
        F.when(F.col("o_custkey") % 3 != 0, F.array(ship)).otherwise(F.array().cast(
            "array<struct<id:string,status:string,duration_ms:int,checks:array<struct<id:string,passed:boolean,evidence_sha256:string>>>>")),
    )
    body = _json(
        F.lit("contract.v1").alias("schema"), F.when(key % 101 == 0, "bad").otherwise(digest("a")).alias("fixture_sha256"),
        digest("b").alias("verifier_sha256"), F.array(*[F.lit(s) for s in ("make", "check", "ship")]).alias("required_stages"),
        F.create_map(*[F.lit(x) for x in ("built", "make", "tested", "check", "sent", "ship")]).alias("required_checks"),
        stages.alias("stages"),
    )
    return o.select(_str("o_orderkey").alias("session_id"), body.alias("body"))


def memory_docs(spark: SparkSession, sf: str, by_nation: bool = False) -> DataFrame:
    """One memory-service export per customer, or per nation, from counts of its orders."""
    o = table(spark, sf, "orders")
    key = F.col("owner")
    if by_nation:
        home = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner"))
        o = o.join(home, "o_custkey")
    else:
        o = o.withColumn("owner", F.col("o_custkey"))
    n = o.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in ("F", "O", "P")]
    )
    body = _json(
        F.lit("memory.v1").alias("schema"),
        F.when(key % 2 == 0, "sqlite").otherwise("postgres").alias("backend"),
        F.struct(F.lit("s").alias("start")).alias("period"),
        F.struct(
            (key % 7).alias("event_count"), F.col("n").alias("turn_total"), F.col("f").alias("turn_abstain"),
            F.struct(F.col("n").alias("/v1/turn"), F.col("o").alias("/")).alias("routes"),
        ).alias("audit"),
        F.struct(F.col("p").alias("proposed_pending_total"), (F.col("o") % 3).alias("accepted_total")).alias("store"),
    )
    return n.select(_str("owner").alias("session_id"), body.alias("body"))


# --- graphs -----------------------------------------------------------------


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Customer, order, line and answer as a typed graph; one session per nation, parts stay undeclared."""
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.concat(F.lit("n"), _str("c_nationkey")).alias("session_id")
    )
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey").join(cust, "custkey")
    lines = table(spark, sf, "lineitem").join(
        orders.select("session_id", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"
    )
    cid, oid = F.concat(F.lit("c"), _str("custkey")), F.concat(F.lit("o"), _str("o_orderkey"))
    strings = "array<string>"

    def rows(df, ident, kind, role, error, parents, relations):
        return df.select(
            "session_id", ident.alias("id"), F.lit(kind).alias("kind"), F.lit(role).cast("string").alias("role"),
            F.lit(None).cast("string").alias("name"), F.lit("").alias("signature"), error.alias("is_error"),
            F.lit(None).cast("string").alias("parent_id"), parents.cast(strings).alias("parent_ids"),
            F.map_from_arrays(parents.cast(strings), F.array(*[F.lit(r) for r in relations]).cast(strings)).alias("parent_relations")
            if relations is not None else F.lit(None).cast("map<string,string>").alias("parent_relations"),
        )

    no = F.lit(False)
    line_id = F.concat_ws("-", F.concat(F.lit("l"), _str("l_orderkey")), "l_partkey", "l_suppkey", "l_linenumber")
    line_parents = F.array(F.concat(F.lit("o"), _str("l_orderkey")), F.concat(F.lit("p"), _str("l_partkey")))
    answer_parents = F.when(F.col("o_orderstatus") != "P", F.array(oid)).otherwise(F.array().cast(strings))
    return (
        rows(cust, cid, "user_request", None, no, F.array(), ())
        .unionByName(rows(orders, oid, "artifact", None, no, F.array(cid), ("created",)))
        .unionByName(rows(lines, line_id, "test_run", None, F.col("l_returnflag") == "R", line_parents, ("verified_by", "used")))
        .unionByName(rows(orders, F.concat(F.lit("r"), _str("o_orderkey")), "final_response", "assistant", no, answer_parents, None))
        .dropDuplicates(["session_id", "id"])
    )


def ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a successor graph over small numbers per user: many cycles with long tails."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        _str("user_id").alias("session_id"), k.cast("string").alias("src"),
        ((k * 3 + F.col("user_id")) % 100).cast("string").alias("dst"), F.lit("next").alias("relation"),
    )


def ring_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("session_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns(
        {"kind": F.lit("step"), "role": F.lit(None).cast("string"), "is_error": F.lit(False)}
    )


# --- context capture --------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` with the request number and the latest user turn."""
    c = table(spark, sf, "conversations").withColumn("session_id", F.concat(F.lit("c"), _str("conv_id")))
    user = F.col("role") == "user"
    return running(
        c, ["session_id"], ["turn"],
        [Running("n", "sum", user.cast("int")), Running("asked", "last", F.when(user, F.col("turn")))],
        seq_segment("turn", largest_group(c, "session_id")),
    )


def host_records(spark: SparkSession, sf: str) -> DataFrame:
    """Host records of a capture: prompts, payload snapshots, tool calls, answers and usage."""
    t = turns(spark, sf)
    conv, turn, session = F.col("conv_id"), F.col("turn"), F.col("session_id")
    ident = lambda position: F.concat(session, F.lit("-"), position.cast("string"))
    say = _json(F.col("text"))
    doubled = F.concat(F.col("text"), F.lit(" / "), F.col("text"))
    part = F.struct(F.lit("text").alias("type"), doubled.alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(part).alias("content"))
    payload = _json(
        F.struct(F.array(message).alias("messages")).alias("payload"), (conv % 4 == 0).alias("provisional"),
        (conv % 4 != 0).alias("final"),
    )
    summary = _json(
        F.concat(F.lit("summary of "), turn.cast("string")).alias("text"),
        F.array(ident(F.lit(0)), ident(F.lit(8))).alias("ancestorEventIds"),
    )
    answers_to = F.when(conv % 2 == 0, F.when(conv % 14 == 0, F.concat(session, F.lit("-missing"))).when(
        conv % 10 == 4, F.concat(F.lit("c"), (conv + 2).cast("string"), F.lit("-1"))).otherwise(ident(F.col("asked") * 8 + 1)))
    tool = [
        F.concat(F.lit("t"), _str("conv_id"), F.lit("-"), turn.cast("string")).alias("toolCallId"), F.lit("read").alias("toolName"),
        F.struct(
            F.concat(F.lit("/src/f"), turn.cast("string"), F.lit(".py")).alias("path"), turn.alias("offset"), F.lit(10).alias("limit")
        ).alias("input"),
    ]
    is_user, is_answer = F.col("role") == "user", F.col("role") == "assistant"
    plan = [
        (0, "system_prompt", F.col("role") == "system", say), (0, "prompt", is_user, say),
        (1, "payload", is_user & (conv % 2 == 0), payload), (2, "compaction", is_user & (turn == 4), summary),
        (0, "tool_call", is_answer & (turn % 4 == 3), _json(*tool)),
        (1, "tool_result", is_answer & (turn % 4 == 3), _json(*tool, F.col("text").alias("content"))),
        (2, "response", is_answer, _json(F.col("text"), answers_to.alias("payloadEventId"))),
        (3, "usage", is_answer, _json(F.length("text").alias("input"), turn.alias("output"))),
        (4, "extension", is_answer & (turn == 1), _json(F.concat(F.lit("ext"), (conv % 3).cast("string")).alias("name"))),
        (5, "skill", is_answer & (turn == 1), _json(
            F.concat(F.lit("skill-"), (conv % 5).cast("string")).alias("name"), F.lit("/home/u/skill.md").alias("filePath"))),
        (6, "context_file", is_answer & (turn == 1), _json(F.lit("/repo/AGENTS.md").alias("path"), F.col("text").alias("content"))),
    ]
    slots = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), body.alias("body"))) for k, kind, test, body in plan
    ]))
    rows = t.select("session_id", "turn", "n", F.explode(slots).alias("s"))
    seq = F.col("turn") * 8 + F.col("s.k")
    return rows.select(
        "session_id", seq.alias("seq"), F.concat(F.col("session_id"), F.lit("-"), seq.cast("string")).alias("event_id"),
        F.date_format(F.timestamp_seconds(F.lit(1767225600) + seq), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("wall_time"),
        F.concat(F.col("session_id"), F.lit(":r"), F.col("n").cast("string")).alias("request_id"),
        F.lit(None).cast("string").alias("attempt_id"), F.col("s.type").alias("type"), F.col("s.body").alias("body"),
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    """Context events of the capture."""
    from ..sources.adapters import pi_host_events

    return pi_host_events(host_records(spark, sf), KEY)


def match_inputs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with their text and payloads with their JSON, for text matching."""
    base = ["session_id", "request_id", "seq", "event_id"]
    text = F.coalesce(F.get_json_object("body", "$.text"), F.get_json_object("body", "$.content"))
    sources = records.filter(F.col("type").isin("prompt", "system_prompt", "tool_result", "context_file")).select(
        *base, text.alias("text")
    )
    payloads = records.filter(F.col("type") == "payload").select(*base, F.get_json_object("body", "$.payload").alias("payload"))
    return sources, payloads


def capture(spark: SparkSession, sf: str) -> DataFrame:
    """Context events together with the verified matches, as a stored table."""
    from ..operators.matching import inclusions, text_matches
    from ..sources.adapters import pi_host_events

    records = cut(host_records(spark, sf))
    events = cut(pi_host_events(records, KEY))
    return cut(events.unionByName(inclusions(text_matches(*match_inputs(records)), events)))


# --- transcripts and hooks --------------------------------------------------


def rollout_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as rollout transcripts (session_id, ordinal, line); some lines are broken."""
    c = table(spark, sf, "conversations")
    turn = F.col("turn")
    stamp = turn.cast("string").alias("timestamp")
    meta = _json(
        stamp, F.lit("session_meta").alias("type"),
        F.struct(F.concat(F.lit("s"), _str("conv_id")).alias("id"), F.lit("1.0").alias("cli_version")).alias("payload"),
    )
    start = _json(stamp, F.lit("turn_context").alias("type"), F.struct(turn.alias("n")).alias("payload"))
    item = F.struct(
        F.concat(F.lit("i"), turn.cast("string")).alias("id"), F.col("role"),
        F.array(F.struct(
            F.when(F.col("role") == "assistant", "output_text").otherwise("input_text").alias("type"), F.col("text")
        )).alias("content"),
    )
    spoken = _json(stamp, F.lit("response_item").alias("type"), item.alias("payload"))
    usage = _json(stamp, F.lit("event_msg").alias("type"), F.struct(
        F.lit("token_count").alias("type"),
        F.struct(F.struct(turn.alias("input_tokens"), (turn * 2).alias("output_tokens")).alias("total_token_usage")).alias("info"),
    ).alias("payload"))
    none = F.lit(None).cast("string")
    answer = F.col("role") == "assistant"
    slots = F.array(
        F.when(turn == 0, meta).otherwise(none), F.when((F.col("role") == "user") & (turn % 4 == 0), start).otherwise(none),
        spoken, F.when(answer, usage).otherwise(none), F.when(answer & (F.col("conv_id") % 9 == 0), F.lit("{cut")).otherwise(none),
    )
    rows = c.select(_str("conv_id").alias("source"), "turn", F.posexplode(slots).alias("k", "line")).filter(F.col("line").isNotNull())
    return _numbered_lines(rows, ["turn", "k"]).select(F.col("source").alias("session_id"), "ordinal", "line")


def hook_records(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as hook records: one boundary per event type, with some unsupported ones."""
    ev = table(spark, sf, "events")
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "PreToolUse").when(kind == "purchase", "PostToolUse").when(kind == "view", "UserPromptSubmit")
        .when(kind == "signup", F.when(F.col("event_id") % 2 == 0, "SessionStart").otherwise("PreCompact"))
        .otherwise(F.when(F.col("event_id") % 2 == 0, "Stop").otherwise("Elsewhere"))
    )
    tool = F.when(kind.isin("click", "purchase"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")))
    body = _json(
        name.alias("hook_event_name"), F.concat(F.lit("u"), _str("user_id")).alias("session_id"), tool.alias("tool_name"),
        F.when(kind == "view", F.concat(F.lit("prompt "), _str("value"))).alias("prompt"),
        F.when(kind == "purchase", F.col("props")).alias("tool_response"),
    )
    return ev.select(
        F.concat(F.lit("u"), _str("user_id")).alias("session_id"), F.col("event_id").alias("seq"),
        _str("event_id").alias("wall_time"), body.alias("body"),
    )
