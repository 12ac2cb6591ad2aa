"""DuckDB SQL with the same results as the registered queries, over the driver tables."""

from __future__ import annotations

import hashlib

from .. import fixed_values as fv
from .queries import PHRASES
from .standin import KEY

# --- shared pieces ----------------------------------------------------------

TRACE = """
base AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id, CAST(event_id AS VARCHAR) AS id, value,
    CASE WHEN event_type = 'click' THEN 'tool_call' WHEN event_type IN ('purchase', 'error') THEN 'tool_result' ELSE 'message' END AS kind,
    CASE event_type WHEN 'view' THEN 'user' WHEN 'signup' THEN 'assistant' END AS role,
    CASE WHEN event_type = 'click' THEN 'tool' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS VARCHAR) END AS name,
    event_type = 'error' AS is_error,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events),
linked AS (
  SELECT *, lag(id) OVER w AS previous,
    last_value(CASE WHEN kind = 'tool_call' THEN id END IGNORE NULLS) OVER (
      PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_call
  FROM base WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
trace AS (
  SELECT session_id, seq, id, kind, role, name, is_error, value,
    CASE WHEN kind = 'tool_result' THEN coalesce(last_call, previous) ELSE previous END AS parent_id
  FROM linked)"""

CALLS = """
outcome AS (
  SELECT session_id, parent_id AS id, bool_or(is_error) AS failed, bool_or(NOT is_error) AS succeeded
  FROM trace WHERE kind = 'tool_result' AND parent_id IS NOT NULL GROUP BY 1, 2),
calls AS (
  SELECT t.session_id, t.seq, t.id, t.name, row_number() OVER (PARTITION BY t.session_id ORDER BY t.seq) AS n,
    coalesce(o.failed, false) AS failed, coalesce(o.succeeded, false) AS succeeded
  FROM trace t LEFT JOIN outcome o USING (session_id, id) WHERE t.kind = 'tool_call')"""

REPEATED = """
near AS (
  SELECT a.session_id, a.n, a.name, count(*) AS c, count(*) FILTER (b.failed) AS f, bool_or(b.succeeded) AS ok,
    string_agg(b.id, ',' ORDER BY b.n) AS evidence
  FROM calls a JOIN calls b ON a.session_id = b.session_id AND a.name = b.name AND b.n BETWEEN a.n - 7 AND a.n
  GROUP BY 1, 2, 3),
repeated AS (
  SELECT session_id, name, min(n) AS position, arg_min(evidence, n) AS evidence, arg_min(c, n) AS c
  FROM near WHERE c >= 3 AND f >= 2 AND NOT ok GROUP BY 1, 2)"""

ALTERNATING = """
fours AS (
  SELECT session_id, n, name AS d, lag(name, 1) OVER w AS c, lag(name, 2) OVER w AS b, lag(name, 3) OVER w AS a,
    lag(id, 3) OVER w || ',' || lag(id, 2) OVER w || ',' || lag(id, 1) OVER w || ',' || id AS evidence,
    CAST(failed AS INT) + lag(CAST(failed AS INT), 1) OVER w + lag(CAST(failed AS INT), 2) OVER w
      + lag(CAST(failed AS INT), 3) OVER w AS f
  FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY n)),
alternating AS (
  SELECT session_id, arg_min(evidence, n) AS evidence FROM fours
  WHERE a = c AND b = d AND a <> b AND f >= 2 GROUP BY 1)"""

ERRORS = """
signed AS (
  SELECT r.session_id, r.seq, r.id, r.is_error, c.name FROM trace r
  JOIN trace c ON c.session_id = r.session_id AND c.id = r.parent_id AND c.kind = 'tool_call' WHERE r.kind = 'tool_result'),
good AS (SELECT session_id, name, max(seq) AS last_ok FROM signed WHERE NOT is_error GROUP BY 1, 2),
errs AS (
  SELECT t.session_id, t.seq, t.id, coalesce(g.last_ok > t.seq, false) AS recovered
  FROM trace t LEFT JOIN signed s ON s.session_id = t.session_id AND s.id = t.id
  LEFT JOIN good g ON g.session_id = s.session_id AND g.name = s.name WHERE t.is_error),
open_errs AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM errs WHERE NOT recovered),
unrecovered AS (
  SELECT e.session_id, count(*) AS total, count(*) FILTER (NOT recovered) AS open,
    (SELECT string_agg(id, ',' ORDER BY seq) FROM open_errs o WHERE o.session_id = e.session_id AND rn <= 10) AS evidence
  FROM errs e GROUP BY e.session_id HAVING count(*) FILTER (NOT recovered) > 0)"""

LAST = """
ending AS (SELECT session_id, arg_max(id, seq) AS id, arg_max(is_error, seq) AS is_error FROM trace GROUP BY 1)"""

FINDINGS = """
findings AS (
  SELECT session_id, 1 AS detector, position, 'repeated_action' AS code, 'warning' AS severity FROM repeated
  UNION ALL SELECT session_id, 2, 0, 'alternating_loop', 'warning' FROM alternating
  UNION ALL SELECT session_id, 3, 0, 'errors', 'warning' FROM unrecovered
  UNION ALL SELECT session_id, 5, 0, 'dead_end', 'critical' FROM ending WHERE is_error)"""

ALL_FINDINGS = ",".join([TRACE, CALLS, REPEATED, ALTERNATING, ERRORS, LAST, FINDINGS])

HEALTH = """
kids AS (SELECT session_id, parent_id, count(*) AS c FROM trace WHERE parent_id IS NOT NULL GROUP BY 1, 2),
forks AS (SELECT session_id, count(*) FILTER (c > 1) AS branches FROM kids GROUP BY 1),
lost AS (
  SELECT session_id, count(*) AS findings, sum(CASE severity WHEN 'info' THEN 3 WHEN 'warning' THEN 12 ELSE 30 END) AS lost,
    coalesce(list(DISTINCT code) FILTER (severity = 'critical'), []) AS critical
  FROM findings GROUP BY 1),
metrics AS (
  SELECT t.session_id, count(*) AS events, count(t.parent_id) AS edges, CAST(0 AS BIGINT) AS merge_events,
    count(*) FILTER (kind = 'tool_call') AS tool_calls, coalesce(any_value(f.branches), 0) AS branches,
    coalesce(any_value(l.findings), 0) AS findings,
    CAST(greatest(0, 100 - coalesce(any_value(l.lost), 0)) AS BIGINT) AS workflow_health,
    coalesce(any_value(l.critical), []) AS critical
  FROM trace t LEFT JOIN forks f USING (session_id) LEFT JOIN lost l USING (session_id) GROUP BY 1),
pairs AS (
  SELECT b.session_id AS before, a.session_id AS after, b, a FROM metrics b
  JOIN metrics a ON CAST(a.session_id AS BIGINT) = CAST(b.session_id AS BIGINT) + 1)"""


#: The trace as generic lines give it: every third event leaves its parent out and follows the event before it.
GENERIC = TRACE.replace(
    "CASE WHEN kind = 'tool_result'", "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN previous WHEN kind = 'tool_result'")
SCORED = "events, edges, merge_events, tool_calls, branches, findings, workflow_health FROM metrics"


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)} {select}"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(pattern: str) -> tuple[str, str]:
    """Split a leading (?i) off a pattern: DuckDB takes flags as an argument."""
    return (pattern[4:], "i") if pattern.startswith("(?i)") else (pattern, "")


# The oracle engine's \b knows ASCII words only, Spark's follows Unicode here; the two agree on the driver tables.
def _redacted(text: str) -> str:
    for label, pattern in fv.REDACTIONS:
        body, flag = _plain(pattern)
        text = f"regexp_replace({text}, {_literal(body)}, '<redacted:{label}>', 'g{flag}')"
    return text


def _labels(text: str) -> str:
    """List of redaction labels of a text column."""
    lists, current = [], text
    for label, pattern in fv.REDACTIONS:
        body, flag = _plain(pattern)
        inline = f"(?{flag})" if flag else ""
        lists.append(f"list_transform(regexp_extract_all({current}, {_literal(inline + body)}), lambda x: '{label}')")
        current = f"regexp_replace({current}, {_literal(body)}, '<redacted:{label}>', 'g{flag}')"
    return " || ".join(lists)


def _canonical(text: str) -> str:
    lowered = f"regexp_replace(lower({_redacted(text)}), '\\b\\d+\\b', '<n>', 'g')"
    return f"coalesce(trim(regexp_replace({lowered}, '\\s+', ' ', 'g')), 'null')"


def _finger(*canonical: str) -> str:
    return f"substr(sha256({' || chr(31) || '.join(canonical)}), 1, 16)"


def _hmac(message: str) -> str:
    key = hashlib.sha256(KEY.encode()).digest().ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ x:02X}" for b in key) for x in (0x36, 0x5C)]
    return f"substr(sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({message})))), 1, 32)"


def _version(text: str) -> str:
    return f"'cv_' || {_hmac(text)}"


def _keyed(kind: str, material: str) -> str:
    return _hmac(f"'{kind}:' || {material}")


def _chars(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _tokens(text: str) -> str:
    return f"CAST(greatest(1, ceil({_chars(text)} / 4.0)) AS BIGINT)"


def _findings_sql() -> dict[str, str]:
    any_phrase = " OR ".join(f"contains(lower(text), {_literal(p)})" for p in PHRASES)
    severity = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
    priority = "CASE code WHEN 'dead_end' THEN 0 WHEN 'errors' THEN 1 WHEN 'alternating_loop' THEN 2 ELSE 3 END"
    ranked = f"""ranked AS (
      SELECT session_id, code, row_number() OVER (PARTITION BY session_id ORDER BY {severity}, {priority}, code, detector, position) AS rank
      FROM findings)"""
    return {
        "session_health": _with(ALL_FINDINGS, HEALTH, select="""SELECT session_id, events, edges, merge_events, tool_calls, branches,
          findings, workflow_health FROM metrics"""),
        "repeated_action": _with(TRACE, CALLS, REPEATED, select="""SELECT session_id, position,
          'Repeated ' || name || ' action ' || c || ' times in a short window' AS summary, evidence FROM repeated"""),
        "alternating_loop": _with(TRACE, CALLS, ALTERNATING, select="SELECT session_id, evidence FROM alternating"),
        "unrecovered_errors": _with(TRACE, ERRORS, select="""SELECT session_id, evidence,
          'Observed ' || open || ' unrecovered error(s)' || CASE WHEN total > open THEN ' (' || total || ' total; ' || (total - open)
          || ' later recovered by a retry of the same tool)' ELSE '' END AS summary FROM unrecovered"""),
        "dead_end": _with(TRACE, LAST, select="SELECT session_id, id AS evidence FROM ending WHERE is_error"),
        "user_correction": f"""WITH hits AS (
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
            FROM conversations WHERE role = 'user' AND ({any_phrase}))
          SELECT CAST(conv_id AS VARCHAR) AS session_id, 'Detected ' || count(*) || ' likely user correction turns' AS summary,
            string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (rn <= 10) AS evidence FROM hits GROUP BY conv_id""",
        "dangling_edges": _with(TRACE, """kept AS (SELECT * FROM trace WHERE CAST(id AS BIGINT) % 10 <> 0)""", """lost AS (
            SELECT k.session_id, k.id, row_number() OVER (PARTITION BY k.session_id ORDER BY k.seq) AS rn FROM kept k
            WHERE k.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.session_id = k.session_id AND p.id = k.parent_id))""",
            select="""SELECT session_id, 'Graph has ' || count(*) || ' events whose parent is absent' AS summary,
              string_agg(id, ',' ORDER BY rn) FILTER (rn <= 10) AS evidence FROM lost GROUP BY session_id"""),
        "session_metrics": _with(TRACE, select="""SELECT session_id, count(*) AS events, count(parent_id) AS edges,
          CAST(0 AS BIGINT) AS merge_events, count(*) FILTER (kind = 'tool_call') AS tool_calls FROM trace GROUP BY 1"""),
        "branches": _with(TRACE, """kids AS (SELECT session_id, parent_id, count(*) AS c FROM trace WHERE parent_id IS NOT NULL GROUP BY 1, 2)""",
            select="SELECT session_id, count(*) FILTER (c > 1) AS branches FROM kids GROUP BY 1"),
        "tool_counts": _with(TRACE, select="SELECT session_id, name AS tool, count(*) AS calls FROM trace WHERE kind = 'tool_call' GROUP BY 1, 2"),
        "analysis_sink": _with(TRACE, select="""SELECT session_id, 'session_metrics' AS part, 1 AS rows FROM trace GROUP BY 1
            UNION ALL SELECT session_id, 'graph_nodes', count(*) FROM trace GROUP BY 1
            UNION ALL SELECT session_id, 'graph_edges', count(*) FROM trace WHERE parent_id IS NOT NULL GROUP BY 1
            UNION ALL SELECT session_id, 'tool_counts', count(DISTINCT name) FROM trace WHERE kind = 'tool_call' GROUP BY 1
            UNION ALL SELECT session_id, 'usage', 1 FROM trace GROUP BY 1"""),
        "usage_totals": _with(TRACE, select="SELECT session_id, 'value' AS counter, round(sum(value), 2) AS total FROM trace GROUP BY 1"),
        "compare_sessions": _with(ALL_FINDINGS, HEALTH, select="SELECT before, after, metric, delta FROM (" + " UNION ALL ".join(
            f"SELECT before, after, '{name}' AS metric, CAST(a.{column} - b.{column} AS DOUBLE) AS delta FROM pairs"
            for name, column in (("events", "events"), ("tool_calls", "tool_calls"), ("branches", "branches"),
                                 ("workflow_health", "workflow_health"), ("merge_events", "merge_events"),
                                 ("finding_delta", "findings"))) + ")"),
        "scorecard": _with(ALL_FINDINGS, HEALTH, """scored AS (
            SELECT before, after, a.workflow_health - b.workflow_health AS health_delta, a.findings - b.findings AS finding_delta,
              list_sort(list_filter(a.critical, lambda x: NOT list_contains(b.critical, x))) AS fresh FROM pairs)""",
            select="""SELECT before, after, health_delta >= 1 AND finding_delta <= 0 AND len(fresh) = 0 AS ok,
              concat_ws(',', CASE WHEN health_delta < 1 THEN 'workflow_health_delta' END,
                CASE WHEN finding_delta > 0 THEN 'finding_delta' END,
                CASE WHEN len(fresh) > 0 THEN 'no_new_critical_findings' END) AS failed_gates,
              health_delta, finding_delta, false AS new_dangling, array_to_string(fresh, ',') AS new_critical FROM scored"""),
        "topology_rank": _with(ALL_FINDINGS, ranked, select="""SELECT session_id, CAST(rank AS INT) AS rank, code, 'spine' AS role
          FROM ranked WHERE rank <= 3"""),
        "topology_plan": _with(ALL_FINDINGS, ranked, """used AS (
            SELECT session_id, arg_min(code, rank) AS main, list(code ORDER BY rank) AS codes FROM ranked WHERE rank <= 3 GROUP BY 1)""", """planned AS (
            SELECT t.session_id, u.main, coalesce(u.codes, []) AS codes, coalesce(list_contains(u.codes, 'errors'), false) AS classify,
              coalesce(list_contains(u.codes, 'alternating_loop'), false) AS checkpoint,
              coalesce(list_contains(u.codes, 'repeated_action'), false) AS retry,
              coalesce(list_contains(u.codes, 'dead_end'), false) AS handoff
            FROM (SELECT DISTINCT session_id FROM trace) t LEFT JOIN used u USING (session_id))""",
            select="""SELECT session_id, main AS primary_finding, array_to_string(codes, ',') AS findings_used,
              concat_ws(',', CASE WHEN classify THEN 'classify' END, CASE WHEN checkpoint THEN 'checkpoint' END,
                CASE WHEN retry THEN 'retry' END, CASE WHEN handoff THEN 'handoff' END) AS flags,
              concat_ws(',', CASE WHEN classify THEN 'classify-then-act' END, CASE WHEN checkpoint THEN 'checkpoint' END,
                CASE WHEN retry OR main = 'errors' THEN 'bounded-retry' END, CASE WHEN retry THEN 'retry-with-new-hypothesis' END,
                CASE WHEN main IS NULL THEN 'do,verify' END,
                CASE WHEN main = 'dead_end' AND NOT retry THEN 'act' END,
                CASE WHEN main = 'alternating_loop' AND NOT retry THEN 'strategy-fork' END,
                CASE WHEN handoff THEN 'handoff' END) AS phases,
              concat_ws(' → ', 'Start', CASE WHEN classify THEN 'ClassifyFailure' END, CASE WHEN main IS NULL THEN 'Do' ELSE 'Act' END,
                CASE WHEN main = 'alternating_loop' THEN 'Summarize → PickStrategy' END, CASE WHEN retry THEN 'RetryBudget(2)' END, 'Verify',
                CASE WHEN handoff THEN 'Handoff' END, 'Done') AS node_sequence FROM planned"""),
    }


def _text_sql() -> dict[str, str]:
    checks = [
        ("absolute personal home path", f"regexp_matches(body, {_literal(fv.HOME_PATH)})"),
        ("private network address", f"regexp_matches(body, {_literal(fv.PRIVATE_IP)})"),
        ("non-example email address", "len(list_filter(regexp_extract_all(body, " + _literal(r"[\p{L}\p{N}_.+-]+@([\p{L}\p{N}_.-]+\.[A-Za-z]{2,})")
         + ", 1), lambda d: lower(d) NOT IN (" + ", ".join(map(_literal, fv.ALLOWED_MAIL_DOMAINS)) + "))) > 0"),
        ("credential-shaped token", f"regexp_matches(body, {_literal(fv.CREDENTIAL_TOKEN)})"),
    ]
    hygiene = "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in checks) + ")"
    secret = " OR ".join(
        f"regexp_matches(text, {_literal(_plain(p)[0])}{', ' + repr('i') if _plain(p)[1] else ''})" for p in fv.SECRET_LIKE
    )
    name = "regexp_extract(url, '[^/]*$')"
    return {
        "redact_documents": f"""SELECT doc_id, sha256({_redacted('text')}) AS redacted_sha,
          array_to_string({_labels('text')}, ',') AS labels FROM documents""",
        "redaction_label_counts": f"""SELECT lang, label, count(*) AS hits FROM (
          SELECT lang, unnest({_labels('text')}) AS label FROM documents) GROUP BY 1, 2""",
        "canonical_fingerprint": f"""SELECT doc_id, {_finger("'doc'", _canonical('lang'), _canonical('text'))} AS fingerprint FROM documents""",
        "content_versions": f"""SELECT version, count(*) AS copies, min(doc_id) AS first_doc FROM (
          SELECT doc_id, {_version('text')} AS version FROM documents) GROUP BY 1""",
        "secret_like_flag": f"SELECT doc_id, {secret} AS secret_like FROM documents",
        "line_hygiene": f"""SELECT * FROM (SELECT doc_id, line, {hygiene} AS labels FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line
          FROM documents)) WHERE labels <> ''""",
        "page_paths": f"""SELECT page_id,
          list_has_any(string_split(path, '/'), [{', '.join(map(_literal, (*fv.PRIVATE_FOLDERS, '.state')))}])
            OR regexp_extract(name, '^\\.*[^.].*\\.([^.]+)$', 1) IN ({', '.join(map(_literal, fv.PRIVATE_SUFFIXES))})
            OR name IN ({', '.join(map(_literal, fv.PRIVATE_NAMES))})
            OR (starts_with(name, '.env.') AND name <> '.env.example') AS private_name,
          ends_with(path, '.jsonl') AND NOT list_has_any(string_split(path, '/'), ['fixtures', 'examples']) AS stray_log,
          CASE WHEN name = '' THEN path ELSE name END AS basename FROM (SELECT page_id, path, string_split(path, '/')[-1] AS name FROM (
            SELECT page_id, url || (['', '/.env', '/a.pem', '/a.PEM', '/.venv/a.py', '/run.jsonl', '/fixtures/run.jsonl', '/.env.example', '/.env.local', '/.key',
              '/.state/a'])[page_id % 11 + 1] AS path FROM pages))""",
        "sanitize_nested": f"""SELECT doc_id, array_to_string({_labels('text')} || ['api_key', 'db_password'], ',') AS labels,
          sha256({_redacted('text')}) AS note_sha, '{{"DB Password":"<redacted:db_password>"}}' AS login, lang FROM documents""",
        "size_estimates": f"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST({_chars('text')} AS BIGINT) AS chars,
          {_tokens('text')} AS tokens FROM documents""",
    }


def _ingest_sql() -> dict[str, str]:
    content = "'value ' || value || ' noted'"
    argument = "CASE WHEN kind = 'tool_call' THEN '{\"k\":\"' || substr(name, 5, 1) || '\"}' ELSE " + _canonical("content") + " END"
    pi_parts = """said AS (
        SELECT *, 'conv-' || conv_id AS session_id, 'm' || conv_id || '-' || turn AS mid, role = 'assistant' AS answer FROM conversations),
      placed AS (
        SELECT *, 1 + coalesce(sum(CASE WHEN answer THEN 2 ELSE 1 END) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM said)"""
    loop = """raw AS (
        SELECT 'order-' || l_orderkey AS session_id, l_linenumber AS n, l_returnflag = 'R' AS returned, l_returnflag, l_linestatus,
          l_suppkey, l_quantity, l_extendedprice,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
      loops AS (
        SELECT session_id, pos, pos - 1 AS seq, n, 1 + n // 4 AS iteration,
          CASE WHEN n IN (1, 4) THEN 'generate' WHEN n IN (2, 5) THEN 'evaluate' WHEN n = 3 THEN 'validate' WHEN n = 6 THEN 'decision' ELSE 'finish' END AS event,
          CASE WHEN n IN (1, 2, 4, 5) THEN 'adapter' || (l_suppkey % 3) END AS adapter,
          n IN (1, 2, 4, 5) AND returned AS not_ok,
          CASE WHEN returned AND l_linestatus = 'O' THEN 'timeout' END AS failure,
          CASE WHEN n < 6 THEN floor(l_extendedprice) END AS ms,
          CASE WHEN n = 6 THEN CASE WHEN l_quantity > 25 THEN 'retry' ELSE 'stop' END END AS action,
          CASE WHEN n = 7 THEN CASE WHEN l_returnflag = 'A' THEN 'passed' WHEN returned THEN 'running' ELSE 'stopped' END END AS status
        FROM raw),
      named AS (
        SELECT *, 'iteration-' || lpad(CAST(iteration AS VARCHAR), 3, '0') || '-' || event || '-' || lpad(CAST(pos AS VARCHAR), 4, '0') AS id
        FROM loops)"""
    unclassified = "n IN (1, 2, 4, 5) AND not_ok AND failure IS NULL"
    timed_out = "n IN (1, 2, 4, 5) AND failure = 'timeout'"

    def grouped(code, words, test):
        return f"""SELECT session_id, '{code}' AS code, {words} AS summary, string_agg(id, ',' ORDER BY seq) FILTER (rn <= 10) AS evidence
          FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM named WHERE {test}) GROUP BY session_id"""

    stage = "CASE WHEN event IN ('generate', 'evaluate', 'validate') THEN event END"
    return {
        "ingest_generic": _with(TRACE, f"""rows AS (SELECT *, {content} AS content, lag(id) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM trace)""",
            select=f"""SELECT 'user-' || session_id AS session_id, seq - 1 AS seq, id,
              CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN before ELSE parent_id END AS parent_id, kind, role, name,
              {_finger('kind', "coalesce(role, 'null')", "coalesce(name, 'null')", argument)} AS signature, is_error,
              sha256(content) AS text_sha, '' AS redactions, round(value, 2) AS usage_sum FROM rows"""),
        "ingest_pi": _with(pi_parts, select=f"""SELECT session_id, CAST(ordinal * 1048576 AS BIGINT) AS seq, mid AS id,
              CASE WHEN turn > 0 THEN 'm' || conv_id || '-' || (turn - 1) END AS parent_id, 'message' AS kind, role, NULL AS name,
              {_finger("'message'", 'role', "'null'", _canonical('text'))} AS signature, false AS is_error,
              sha256({_redacted('text')} || CASE WHEN answer THEN chr(10) ELSE '' END) AS text_sha, array_to_string({_labels('text')}, ',') AS redactions,
              CASE WHEN answer THEN CAST(turn AS DOUBLE) ELSE 0.0 END AS usage_sum FROM placed
            UNION ALL SELECT session_id, CAST(ordinal * 1048576 + 1 AS BIGINT), 't' || conv_id || '-' || turn, mid, 'tool_call', 'assistant', 'lookup',
              {_finger("'tool_call'", "'lookup'", "'{\"n\":\"' || turn || '\",\"token\":\"<redacted:token>\"}'")}, false,
              sha256('{{"n": ' || turn || ', "token": "<redacted:token>"}}'), 'token', 0.0 FROM placed WHERE answer
            UNION ALL SELECT session_id, CAST((ordinal + 1) * 1048576 AS BIGINT), 'q' || conv_id || '-' || turn, 't' || conv_id || '-' || turn,
              'tool_result', 'toolResult', 'lookup', {_finger("'tool_result'", "'toolresult'", "'lookup'", "'done <n>'")}, conv_id % 3 = 0,
              sha256('done ' || turn), '', 0.0 FROM placed WHERE answer"""),
        "ingest_loop": _with(loop, select=f"""SELECT session_id, seq, id, lag(id) OVER (PARTITION BY session_id ORDER BY seq) AS parent_id,
              'loop_' || event AS kind, 'controller' AS role, coalesce(adapter, event) AS name,
              {_finger("'loop'", 'event', "coalesce(adapter, 'null')", "coalesce(action, 'null')", "coalesce(status, 'null')", "coalesce(failure, 'null')")} AS signature,
              not_ok OR coalesce(status = 'stopped', false) AS is_error, sha256('') AS text_sha, '' AS redactions, 0.0 AS usage_sum FROM named"""),
        "quarantine": """WITH rows AS (SELECT doc_id, 'docs/' || source || '-' || (doc_id % 40) || '.jsonl' AS source, doc_id % 53 AS k FROM documents),
          headless AS (SELECT source FROM rows GROUP BY 1 HAVING arg_min(k, doc_id) IN (0, 1)),
          errors AS (
            SELECT source, CASE k WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'usage_not_finite'
              ELSE 'malformed_parent_ids' END AS reason, count(*) AS rows FROM rows
            WHERE k < 2 OR (k < 4 AND source NOT IN (SELECT source FROM headless)) GROUP BY 1, 2
            UNION ALL SELECT source, 'duplicate_event_id', 1 FROM (
              SELECT source, k FROM rows WHERE k IN (2, 3, 4) AND source NOT IN (SELECT source FROM headless) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY source)
          SELECT * FROM errors UNION ALL SELECT source, 'clean', count(*) FROM rows
          WHERE source NOT IN (SELECT source FROM errors) GROUP BY source""",
        "session_formats": """SELECT 'generic-jsonl' AS format, count(DISTINCT user_id) AS sessions, count(*) AS lines FROM events
          UNION ALL SELECT 'pi-v3', count(DISTINCT conv_id),
            CAST(count(*) + count(*) FILTER (role = 'assistant') + count(*) FILTER (turn = 0) AS BIGINT) FROM conversations
          UNION ALL SELECT 'loop-v1', count(DISTINCT l_orderkey), count(*) FROM lineitem""",
        "loop_metrics": _with(loop, select=f"""SELECT session_id, max(iteration) AS loop_iterations,
              count(*) FILTER (action = 'retry') AS loop_retries, arg_max(status, seq) FILTER (status IS NOT NULL) AS loop_status,
              coalesce(arg_max(coalesce(status, ''), seq) IN ('passed', 'stopped'), false) AS loop_terminal_recorded,
              count(*) FILTER ({unclassified}) AS loop_failure_classification_missing,
              CAST(coalesce(sum(ms), 0) AS DOUBLE) AS loop_duration_ms FROM named GROUP BY 1"""),
        "loop_stage_durations": _with(loop, select=f"""SELECT session_id, {stage} AS stage, CAST(sum(ms) AS DOUBLE) AS duration_ms
              FROM named WHERE ms IS NOT NULL GROUP BY 1, 2"""),
        "loop_bottleneck": _with(loop, """per AS (SELECT session_id, event, sum(ms) AS ms, min(seq) AS s FROM named WHERE ms IS NOT NULL GROUP BY 1, 2)""",
            """top AS (SELECT session_id, sum(ms) AS total, max(ms) AS best, arg_min(event, s) FILTER (ms = top_ms) AS event FROM (
              SELECT *, max(ms) OVER (PARTITION BY session_id) AS top_ms FROM per) GROUP BY 1)""",
            """hot AS (SELECT n.session_id, n.id, n.seq, t.event, 100 * t.best / t.total AS share,
              row_number() OVER (PARTITION BY n.session_id ORDER BY n.seq) AS rn
              FROM top t JOIN named n ON n.session_id = t.session_id AND n.event = t.event AND n.ms IS NOT NULL
              WHERE t.total >= 30000 AND t.best / t.total >= 0.75)""",
            select="""SELECT session_id, 'The ' || any_value(event) || ' stage consumed ' || CAST(round_even(any_value(share), 0) AS INT)
              || '% of recorded agent time' AS summary, string_agg(id, ',' ORDER BY seq) FILTER (rn <= 10) AS evidence FROM hot GROUP BY 1"""),
        "loop_gaps": _with(loop, select=grouped("loop_telemetry_gap", "'Failure classification missing for ' || count(*) || ' agent stage(s)'", unclassified)
            + " UNION ALL " + grouped("agent_timeout", "'Observed ' || count(*) || ' timed-out loop stage(s)'", timed_out)
            + """ UNION ALL SELECT session_id, 'loop_incomplete', 'No recognized terminal record at the end of the selected loop trace',
              arg_max(id, seq) FROM named GROUP BY session_id HAVING arg_max(coalesce(status, ''), seq) NOT IN ('passed', 'stopped')"""),
        "loop_sessions": _with(loop, select="""SELECT session_id, max(iteration) AS iterations,
              arg_max(status, seq) FILTER (status IS NOT NULL) AS status FROM named GROUP BY 1"""),
        "loop_adapters": _with(loop, select="SELECT DISTINCT session_id, adapter FROM named WHERE adapter IS NOT NULL"),
    }


def _report_sql() -> dict[str, str]:
    tries = """tries AS (
        SELECT o_orderkey AS k, o_orderstatus AS st, i, (o_orderkey + i) % 3 < 2 AS ok FROM orders, unnest(range(1, 2 + o_orderkey % 4)) AS u(i)
        WHERE o_orderkey % 89 <> 0)"""
    docs = """docs AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderkey AS k, o_orderkey % 4 <> 0 AS tested, o_custkey % 3 <> 0 AS shipped,
          o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS sent,
          CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'timeout' ELSE 'completed' END AS st
        FROM orders WHERE o_orderkey % 101 <> 0),
      judged AS (
        SELECT *, st = 'completed' AND shipped AND tested AND sent AS success FROM docs)"""
    memory = """memory AS (
        SELECT o_custkey AS k, CAST(o_custkey AS VARCHAR) AS session_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f,
          count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
          CASE WHEN o_custkey % 2 = 0 THEN 'sqlite' ELSE 'postgres' END AS backend, round(f / n, 4) AS rate FROM orders GROUP BY o_custkey)"""
    contract_rows = """parts AS (
        SELECT session_id, 0 AS a, 'run' AS id, NULL AS up, 'pipeline_start' AS kind, false AS bad FROM judged
        UNION ALL SELECT session_id, 1, 'stage-1', NULL, 'pipeline_stage', false FROM judged
        UNION ALL SELECT session_id, 2, 'check-1', 'stage-1', 'pipeline_check', false FROM judged
        UNION ALL SELECT session_id, 3, 'stage-2', NULL, 'pipeline_stage', st <> 'completed' FROM judged
        UNION ALL SELECT session_id, 4, 'check-3', 'stage-2', 'pipeline_check', NOT tested FROM judged
        UNION ALL SELECT session_id, 5, 'stage-3', NULL, 'pipeline_stage', false FROM judged WHERE shipped
        UNION ALL SELECT session_id, 6, 'check-2', 'stage-3', 'pipeline_check', false FROM judged WHERE sent
        UNION ALL SELECT session_id, 7, 'result', NULL, 'pipeline_result', NOT success FROM judged),
      ordered AS (
        SELECT session_id, row_number() OVER w - 1 AS seq, id, coalesce(up, lag(id) OVER w) AS parent_id, kind, bad AS is_error
        FROM parts WINDOW w AS (PARTITION BY session_id ORDER BY a))"""
    digest = hashlib.sha256(
        b'{"checks":{"built":"make","sent":"ship","tested":"check"},"stages":["make","check","ship"]}'
    ).hexdigest()
    fixture = "CASE WHEN k % 7 = 0 THEN 'f' ELSE 'a' END"
    rules = [
        ("k % 7 = 0", "no_gateway_traffic", "info", "export"),
        ("n >= 5 AND rate >= 0.35", "high_abstain_rate", "warning", "turn-abstain"),
        ("p >= 10", "review_backlog", "warning", "review-queue"),
        ("n >= 20 AND o % 3 = 0", "empty_memory_catalog", "critical", "store-empty"),
        ("backend = 'sqlite' AND n >= 200", "postgres_migration_candidate", "info", "backend-sqlite"),
        ("backend = 'postgres' AND n < 5 AND k % 7 > 0", "postgres_overprovisioned", "info", "backend-postgres"),
    ]
    fired = " UNION ALL ".join(
        f"SELECT session_id, '{code}' AS code, '{level}' AS severity, '{proof}' AS evidence FROM memory WHERE {test}"
        for test, code, level, proof in rules)
    return {
        "retrieval_metrics": _with(tries, select="""SELECT CAST(k AS VARCHAR) AS session_id, count(*) AS retrieval_attempts,
              count(*) FILTER (NOT ok) AS retrieval_unsuccessful_attempts, sum(i * 0.5)::DOUBLE AS retrieval_elapsed_s,
              CASE WHEN any_value(st) <> 'F' THEN 1 ELSE 0 END AS retrieval_success,
              CASE WHEN any_value(st) = 'P' THEN 1 ELSE 0 END AS retrieval_escalation_deferred FROM tries GROUP BY k"""),
        "retrieval_events": _with(tries, select=f"""SELECT CAST(k AS VARCHAR) AS session_id, CAST(i AS BIGINT) AS seq, 'attempt-' || i AS id,
              CASE WHEN i = 1 THEN 'fetch' ELSE 'attempt-' || (i - 1) END AS parent_id, 'retrieval_attempt' AS kind, false AS is_error,
              {_finger("'curl'", "'null'", "'null'")} AS signature FROM tries
            UNION ALL SELECT CAST(k AS VARCHAR), 0, 'fetch', NULL, 'retrieval_start', false, '' FROM tries WHERE i = 1
            UNION ALL SELECT CAST(k AS VARCHAR), max(i) + 1, 'result', 'attempt-' || max(i), 'retrieval_result', any_value(st) = 'F', ''
              FROM tries GROUP BY k"""),
        "retrieval_findings": _with(tries, select="""SELECT CAST(k AS VARCHAR) AS session_id, 'escalation_deferred' AS code,
              'warning' AS severity, 'result' AS evidence FROM tries WHERE i = 1 AND st = 'P'"""),
        "contract_metrics": _with(docs, select=f"""SELECT session_id, repeat('a', 64) AS fixture_sha256, '{digest}' AS contract_sha256,
              CAST(3 AS BIGINT) AS pipeline_stages_required, CAST(1 + CAST(st = 'completed' AS INT) + CAST(shipped AS INT) AS BIGINT) AS pipeline_stages_completed,
              CAST(1 - CAST(shipped AS INT) AS BIGINT) AS pipeline_stages_missing, CAST(3 AS BIGINT) AS pipeline_checks_required,
              CAST(1 + CAST(tested AS INT) + CAST(sent AS INT) AS BIGINT) AS pipeline_checks_passed,
              CAST(1 - CAST(tested AS INT) AS BIGINT) AS pipeline_checks_failed, CAST(1 - CAST(sent AS INT) AS BIGINT) AS pipeline_checks_missing,
              CAST(st = 'timeout' AS BIGINT) AS pipeline_timeouts,
              CAST(10 + k % 100 + CASE WHEN shipped THEN 5 ELSE 0 END AS DOUBLE) AS pipeline_duration_ms,
              CAST(success AS INT) AS pipeline_success FROM judged"""),
        "contract_events": _with(docs, contract_rows, select="SELECT * FROM ordered"),
        "contract_findings": _with(docs, contract_rows, select="""SELECT session_id, 'pipeline_contract' AS code,
              string_agg(id, ',' ORDER BY seq) AS evidence FROM ordered WHERE is_error GROUP BY 1"""),
        "contract_checks": """WITH seen AS (
            SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'O' THEN 'built' WHEN l_returnflag = 'N' THEN 'tested' ELSE 'sent' END AS c,
              bool_and(l_quantity > 5) AS passed FROM lineitem GROUP BY 1, 2),
          checks AS (SELECT o_orderkey AS k, c.c, s.passed FROM orders CROSS JOIN (VALUES ('built'), ('tested'), ('sent')) c(c)
            LEFT JOIN seen s ON s.k = o_orderkey AND s.c = c.c),
          totals AS (SELECT k, count(*) AS pipeline_checks_required, count(*) FILTER (passed) AS pipeline_checks_passed,
            count(*) FILTER (NOT passed) AS pipeline_checks_failed, count(*) FILTER (passed IS NULL) AS pipeline_checks_missing FROM checks GROUP BY 1)
          SELECT CAST(k AS VARCHAR) AS session_id, CAST(1 AS BIGINT) AS pipeline_stages_required, CAST(o_orderstatus = 'O' AS BIGINT) AS pipeline_stages_completed,
            CAST(o_orderstatus NOT IN ('O', 'F') AS BIGINT) AS pipeline_stages_missing, CAST(o_orderstatus = 'F' AS BIGINT) AS pipeline_timeouts,
            CAST(2.0 AS DOUBLE) AS pipeline_duration_ms, pipeline_checks_required, pipeline_checks_passed, pipeline_checks_failed, pipeline_checks_missing,
            CAST(o_orderstatus = 'O' AND pipeline_checks_passed = 3 AS INT) AS pipeline_success FROM totals JOIN orders ON o_orderkey = k""",
        "memory_metrics": _with(memory, select="""SELECT session_id, backend, k % 7 AS audit_event_count, n AS turn_total, f AS turn_abstain,
              rate AS turn_abstain_rate, p AS proposed_pending_total, o % 3 AS accepted_total,
              CAST(f / n < 0.5 AND p < 20 AS INT) AS memory_plane_success FROM memory"""),
        "memory_events": _with(memory, select="""SELECT session_id, CAST(0 AS BIGINT) AS seq, 'export' AS id, NULL AS parent_id, 'memory_plane_export' AS kind FROM memory
            UNION ALL SELECT session_id, 1, 'route-root', 'export', 'audit_route' FROM memory
            UNION ALL SELECT session_id, 2, 'route-v1/turn', 'export', 'audit_route' FROM memory
            UNION ALL SELECT session_id, 3, 'review-queue', 'route-v1/turn', 'review_backlog' FROM memory WHERE p > 0"""),
        "memory_findings": _with(memory, select=fired),
        "memory_findings_by_nation": _with(memory.replace("o_custkey", "c_nationkey").replace(
            "FROM orders", "FROM orders JOIN customer ON c_custkey = o_custkey"), select=fired),
        "health_by_file": _with(GENERIC, CALLS, REPEATED, ALTERNATING, ERRORS, LAST, FINDINGS, HEALTH,
            select=f"SELECT 'logs/user-' || session_id || '/trace.jsonl' AS session_id, 'trace' AS session_name, {SCORED}"),
        "format_health": _with(docs, contract_rows, tries, memory, """trace AS (
              SELECT 'contract-' || session_id AS session_id, seq, id, kind, NULL AS name, is_error, parent_id FROM ordered
              UNION ALL SELECT 'retrieval-' || k, i, 'attempt-' || i, 'retrieval_attempt', NULL, false,
                CASE WHEN i = 1 THEN 'fetch' ELSE 'attempt-' || (i - 1) END FROM tries
              UNION ALL SELECT 'retrieval-' || k, 0, 'fetch', 'retrieval_start', NULL, false, NULL FROM tries WHERE i = 1
              UNION ALL SELECT 'retrieval-' || k, max(i) + 1, 'result', 'retrieval_result', NULL, any_value(st) = 'F', 'attempt-' || max(i)
                FROM tries GROUP BY k
              UNION ALL SELECT 'memory-' || session_id, e.seq, e.id, e.kind, NULL, false, e.up FROM memory, unnest([
                {'seq': 0, 'id': 'export', 'kind': 'memory_plane_export', 'up': NULL},
                {'seq': 1, 'id': 'route-root', 'kind': 'audit_route', 'up': 'export'},
                {'seq': 2, 'id': 'route-v1/turn', 'kind': 'audit_route', 'up': 'export'},
                {'seq': 3, 'id': 'review-queue', 'kind': 'review_backlog', 'up': 'route-v1/turn'}]) AS u(e) WHERE e.seq < 3 OR p > 0)""",
            CALLS, REPEATED, ALTERNATING, ERRORS, LAST, FINDINGS.replace("findings AS", "core AS"),
            f"""findings AS (SELECT session_id, code, severity FROM core
              UNION ALL SELECT 'contract-' || session_id, 'pipeline_contract', 'critical' FROM judged WHERE NOT success
              UNION ALL SELECT 'retrieval-' || k, 'escalation_deferred', 'warning' FROM tries WHERE i = 1 AND st = 'P'
              UNION ALL SELECT 'memory-' || session_id, code, severity FROM ({fired}))""",
            HEALTH, select=f"SELECT session_id, {SCORED}"),
        "compare_contracts": _with(docs, f"""sides AS (SELECT *, {fixture} AS fix, 1 + CAST(tested AS INT) + CAST(sent AS INT) AS passed,
              10 + k % 100 + CASE WHEN shipped THEN 5 ELSE 0 END AS ms FROM judged)""",
            "pairs AS (SELECT b.session_id AS before, a.session_id AS after, b, a, b.fix <> a.fix AS differs FROM sides b JOIN sides a ON a.k = b.k + 1)",
            select="SELECT before, after, 'fixture_sha256_mismatch' AS refused, NULL AS metric, NULL::DOUBLE AS delta FROM pairs WHERE differs UNION ALL "
            + " UNION ALL ".join(
                f"SELECT before, after, NULL, '{m}', CAST(CAST(a.{c} AS INT) - CAST(b.{c} AS INT) AS DOUBLE) FROM pairs WHERE NOT differs"
                for m, c in (("pipeline_success", "success"), ("pipeline_checks_passed", "passed"), ("pipeline_duration_ms", "ms")))),
    }


LINEAGE = """
own AS (SELECT c_custkey AS ck, 'n' || c_nationkey AS session_id FROM customer),
sold AS (SELECT o.*, w.session_id FROM orders o JOIN own w ON w.ck = o.o_custkey),
item AS (
  SELECT DISTINCT s.session_id, 'l' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id,
    'o' || l_orderkey AS o, 'p' || l_partkey AS p, first_value(l_returnflag = 'R') OVER (
      PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS bad
  FROM lineitem JOIN sold s ON s.o_orderkey = l_orderkey),
node AS (
  SELECT session_id, 'c' || ck AS id, 'user_request' AS kind, false AS bad FROM own
  UNION ALL SELECT session_id, 'o' || o_orderkey, 'artifact', false FROM sold
  UNION ALL SELECT session_id, id, 'test_run', bad FROM item
  UNION ALL SELECT session_id, 'r' || o_orderkey, 'final_response', false FROM sold),
edge AS (
  SELECT session_id, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'created' AS relation FROM sold
  UNION ALL SELECT session_id, o, id, 'verified_by' FROM item
  UNION ALL SELECT session_id, p, id, 'used' FROM item
  UNION ALL SELECT session_id, 'o' || o_orderkey, 'r' || o_orderkey, 'precedes' FROM sold WHERE o_orderstatus <> 'P')"""

RINGS = """
ring AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, k AS src, (k * 3 + user_id) % 100 AS dst
  FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _graph_sql() -> dict[str, str]:
    return {
        "merge_events": _with(LINEAGE, """indeg AS (SELECT session_id, dst AS id, count(*) AS c FROM edge GROUP BY 1, 2)""",
            select="""SELECT n.session_id, count(*) AS events, CAST(sum(coalesce(c, 0)) AS BIGINT) AS edges,
              count(*) FILTER (c > 1) AS merge_events FROM node n LEFT JOIN indeg USING (session_id, id) GROUP BY 1"""),
        "edge_list": _with(LINEAGE, select="SELECT * FROM edge"),
        "relation_counts": _with(LINEAGE, select="SELECT session_id, relation, count(*) AS edges FROM edge GROUP BY 1, 2"),
        "roots_leaves": _with(LINEAGE, select="""SELECT session_id, 'root' AS end, count(*) AS nodes FROM node n
              WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.session_id = n.session_id AND e.dst = n.id) GROUP BY 1
            UNION ALL SELECT session_id, 'leaf', count(*) FROM node n
              WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.session_id = n.session_id AND e.src = n.id) GROUP BY 1"""),
        "implicit_nodes": _with(LINEAGE, select="SELECT DISTINCT session_id, p AS id FROM item"),
        "graph_issues": """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, json_extract_string(props, '$.k') AS id, event_type AS kind FROM events)
          SELECT session_id, 'duplicate_node_id' AS issue, count(*) AS rows FROM (
            SELECT session_id, id FROM n GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
          UNION ALL SELECT session_id, 'blank_edge_end', count(*) FROM n WHERE id = '7' GROUP BY 1
          UNION ALL SELECT session_id, 'blank_relation', count(*) FROM n WHERE kind = 'error' GROUP BY 1""",
        "artifact_coverage": _with(LINEAGE, """v AS (
            SELECT e.session_id, count(DISTINCT e.src) AS verified FROM edge e JOIN node n ON n.session_id = e.session_id AND n.id = e.dst
            WHERE relation = 'verified_by' AND NOT n.bad GROUP BY 1)""",
            select="""SELECT session_id, count(*) AS changed, coalesce(any_value(verified), 0) AS verified,
              round(coalesce(any_value(verified), 0) / count(*), 4) AS coverage FROM sold LEFT JOIN v USING (session_id) GROUP BY 1"""),
        "request_outputs": _with(LINEAGE, select="""SELECT session_id, count(*) AS outputs,
              count(*) FILTER (o_orderstatus <> 'P') AS reachable FROM sold GROUP BY 1"""),
        "components": _with(LINEAGE,
            "both_ways AS (SELECT session_id, src AS a, dst AS b FROM edge UNION SELECT session_id, dst, src FROM edge)",
            "everyone AS (SELECT session_id, id FROM node UNION SELECT session_id, a FROM both_ways)",
            """cc(session_id, id, comp) USING KEY (session_id, id) AS (
              SELECT session_id, id, id FROM everyone
              UNION SELECT r.session_id, r.id, min(c.comp) FROM cc c JOIN both_ways e ON e.session_id = c.session_id AND e.a = c.id
                JOIN recurring.cc r ON r.session_id = e.session_id AND r.id = e.b WHERE c.comp < r.comp GROUP BY 1, 2)""",
            select="SELECT session_id, id, comp AS component FROM cc", recursive=True),
        "graph_depth": _with(TRACE, """deep AS (
            SELECT session_id, id, CAST(0 AS BIGINT) AS d FROM trace WHERE parent_id IS NULL
            UNION ALL SELECT t.session_id, t.id, d + 1 FROM deep JOIN trace t ON t.session_id = deep.session_id AND t.parent_id = deep.id)""",
            select="SELECT session_id, true AS is_dag, max(d) AS max_depth FROM deep GROUP BY 1", recursive=True),
        "lineage_depth": _with(LINEAGE, """d AS (
            SELECT session_id, 0 AS d FROM own UNION ALL SELECT session_id, 1 FROM sold UNION ALL SELECT session_id, 2 FROM item
            UNION ALL SELECT session_id, 2 FROM sold WHERE o_orderstatus <> 'P')""",
            select="SELECT session_id, true AS is_dag, CAST(max(d) AS BIGINT) AS max_depth FROM d GROUP BY 1"),
        "cycle_nodes": _with(RINGS, """reach AS (
            SELECT session_id, src, dst FROM ring
            UNION SELECT r.session_id, r.src, e.dst FROM reach r JOIN ring e ON e.session_id = r.session_id AND e.src = r.dst)""",
            select="SELECT DISTINCT session_id, CAST(src AS VARCHAR) AS id FROM reach WHERE src = dst", recursive=True),
    }


HOST = """
turns AS (
  SELECT *, 'c' || conv_id AS s, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS n,
    max(CASE WHEN role = 'user' THEN turn END) OVER w AS asked
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
host AS (
  SELECT *, turn * 8 + k AS seq, s || '-' || (turn * 8 + k) AS event_id, s || ':r' || n AS request_id,
    strftime(TIMESTAMP '2026-01-01 00:00:00' + (turn * 8 + k) * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS wall_time
  FROM (
    SELECT *, 0 AS k, 'system_prompt' AS type FROM turns WHERE role = 'system'
    UNION ALL SELECT *, 0, 'prompt' FROM turns WHERE role = 'user'
    UNION ALL SELECT *, 1, 'payload' FROM turns WHERE role = 'user' AND conv_id % 2 = 0
    UNION ALL SELECT *, 2, 'compaction' FROM turns WHERE role = 'user' AND turn = 4
    UNION ALL SELECT *, 0, 'tool_call' FROM turns WHERE role = 'assistant' AND turn % 4 = 3
    UNION ALL SELECT *, 1, 'tool_result' FROM turns WHERE role = 'assistant' AND turn % 4 = 3
    UNION ALL SELECT *, 2, 'response' FROM turns WHERE role = 'assistant'
    UNION ALL SELECT *, 3, 'usage' FROM turns WHERE role = 'assistant'
    UNION ALL SELECT *, 4, 'extension' FROM turns WHERE role = 'assistant' AND turn = 1
    UNION ALL SELECT *, 5, 'skill' FROM turns WHERE role = 'assistant' AND turn = 1
    UNION ALL SELECT *, 6, 'context_file' FROM turns WHERE role = 'assistant' AND turn = 1))"""

# The serialised payload: keys sorted, no blanks.
_PAYLOAD = """'{"messages":[{"content":[{"text":' || CAST(to_json(text || ' / ' || text) AS VARCHAR) || ',"type":"text"}],"role":"user"}]}'"""


def _ctx() -> str:
    tool = "'t' || conv_id || '-' || turn"
    sized = "CASE WHEN type = 'payload' THEN payload WHEN type IN ('prompt', 'tool_result', 'context_file') THEN text END"
    return f"""{HOST},
filled AS (SELECT *, CASE WHEN type = 'payload' THEN {_PAYLOAD} END AS payload, conv_id % 4 = 0 AS provisional FROM host),
ctx AS (
  SELECT s AS session_id, event_id, seq AS producer_seq, request_id, request_id || ':a1' AS attempt_id, wall_time, type, conv_id, turn, text, payload,
    CASE WHEN type IN ('system_prompt', 'prompt', 'tool_call', 'extension', 'skill', 'context_file') THEN 'load'
      WHEN type = 'payload' THEN CASE WHEN provisional THEN 'payload' ELSE 'dispatch' END WHEN type = 'compaction' THEN 'transform'
      WHEN type = 'tool_result' THEN 'read' ELSE type END AS observation,
    CASE WHEN type = 'payload' THEN CASE WHEN provisional THEN 'payload_snapshot' ELSE 'final_dispatch' END
      WHEN type = 'compaction' THEN 'summary_ancestor' WHEN type = 'tool_result' THEN 'read_result' WHEN type = 'usage' THEN 'final_dispatch'
      ELSE 'runtime_loaded' END AS evidence,
    CASE type WHEN 'system_prompt' THEN 'before_agent_start.systemPrompt' WHEN 'prompt' THEN 'before_agent_start.prompt'
      WHEN 'payload' THEN CASE WHEN provisional THEN 'before_provider_request.provisional' ELSE 'before_provider_request.final' END
      WHEN 'compaction' THEN 'compaction' WHEN 'tool_call' THEN 'tool_call.start' WHEN 'tool_result' THEN 'tool_result'
      WHEN 'response' THEN 'message_end.assistant' WHEN 'usage' THEN 'provider_usage' WHEN 'extension' THEN 'extension_execute'
      WHEN 'skill' THEN 'before_agent_start.skills' ELSE 'before_agent_start.contextFiles' END AS boundary,
    CASE WHEN type IN ('skill', 'response') OR (type = 'payload' AND provisional) THEN 'partial'
      WHEN type = 'context_file' AND text = '' THEN 'partial' ELSE 'full' END AS coverage,
    CASE type WHEN 'system_prompt' THEN 'system_input' WHEN 'prompt' THEN 'user_input' WHEN 'payload' THEN 'unattributed'
      WHEN 'compaction' THEN 'summary' WHEN 'tool_call' THEN 'tool_result' WHEN 'tool_result' THEN 'tool_result' WHEN 'response' THEN 'model_output'
      WHEN 'extension' THEN 'other' WHEN 'skill' THEN 'skill' WHEN 'context_file' THEN 'instructions' END AS source_category,
    CASE WHEN type = 'system_prompt' THEN 'Assembled system prompt' WHEN type = 'prompt' THEN 'user_prompt' WHEN type = 'payload' THEN 'provider_payload'
      WHEN type = 'compaction' THEN 'compaction_summary' WHEN type IN ('tool_call', 'tool_result') THEN '/src/f' || turn || '.py'
      WHEN type = 'response' THEN 'Assistant response' WHEN type = 'extension' THEN 'ext' || (conv_id % 3)
      WHEN type = 'skill' THEN 'skill-' || (conv_id % 5) WHEN type = 'context_file' THEN '/repo/AGENTS.md' END AS source_alias,
    CASE WHEN type = 'system_prompt' THEN 'assembled-system-prompt' WHEN type = 'prompt' THEN {_keyed('user_input', 'request_id')}
      WHEN type = 'payload' THEN {_keyed('payload', 'request_id')} WHEN type = 'compaction' THEN {_keyed('summary', 'request_id')}
      WHEN type = 'tool_call' THEN {_keyed('tool_call', "'read:' || " + tool)} WHEN type = 'tool_result' THEN {_keyed('tool_result', "'read:' || " + tool)}
      WHEN type = 'extension' THEN {_keyed('extension', "'ext' || (conv_id % 3)")} WHEN type = 'skill' THEN {_keyed('skill', "'skill-' || (conv_id % 5)")}
      WHEN type = 'context_file' THEN {_keyed('instructions', "'/repo/AGENTS.md'")} END AS source_key,
    CASE WHEN type IN ('system_prompt', 'prompt', 'tool_result', 'response') OR (type = 'context_file' AND text <> '') THEN {_version('text')}
      WHEN type = 'payload' THEN {_version('payload')} WHEN type = 'compaction' THEN {_version("'summary of ' || turn")} END AS content_version_key,
    CASE WHEN type = 'compaction' THEN {_tokens("'summary of ' || turn")} WHEN {sized} IS NOT NULL THEN {_tokens(sized)} END AS estimated_tokens,
    CAST(CASE WHEN type = 'response' THEN strlen(text) ELSE strlen({sized}) END AS BIGINT) AS byte_count,
    CASE WHEN type <> 'payload' AND {sized} IS NOT NULL THEN CAST({_chars(sized)} AS BIGINT) END AS char_count,
    CASE WHEN type = 'payload' THEN 'sha256:' || substr(sha256(payload), 1, 16)
      WHEN type IN ('tool_call', 'tool_result') THEN 'runtime_line_range' END AS match_method,
    CASE WHEN type IN ('tool_call', 'tool_result') THEN {tool} END AS tool_call_id,
    CASE WHEN type = 'usage' THEN CAST(length(text) AS DOUBLE) END AS usage_input_tokens,
    CASE WHEN type = 'usage' THEN CAST(turn AS DOUBLE) END AS usage_output_tokens,
    CASE WHEN type = 'response' AND conv_id % 2 = 0 THEN CASE WHEN conv_id % 14 = 0 THEN s || '-missing'
      WHEN conv_id % 10 = 4 THEN 'c' || (conv_id + 2) || '-1' WHEN asked IS NOT NULL THEN s || '-' || (asked * 8 + 1) END END AS parent,
    CASE WHEN type = 'compaction' THEN s || '-0,' || s || '-8' END AS lineage,
    CASE WHEN type IN ('tool_call', 'tool_result') THEN turn END AS range_start,
    CASE WHEN type IN ('tool_call', 'tool_result') THEN turn + 9 END AS range_end
  FROM filled)"""


def _match_parts() -> str:
    """Recent sources, their payloads and the hits in the doubled prompt text."""
    return """
src AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, request_id ORDER BY producer_seq) AS no FROM ctx
  WHERE type IN ('prompt', 'system_prompt', 'tool_result', 'context_file') AND text <> ''),
pair AS (
  SELECT s.session_id, s.event_id AS source_id, p.event_id AS payload_id, s.text AS source, p.text || ' / ' || p.text AS field,
    row_number() OVER (PARTITION BY p.event_id ORDER BY s.no DESC) AS back
  FROM ctx p JOIN src s ON s.session_id = p.session_id AND s.request_id = p.request_id AND s.producer_seq < p.producer_seq
  WHERE p.type = 'payload'),
piece AS (
  SELECT *, string_split(field, source) AS parts FROM pair WHERE back <= 8 AND contains(field, source)),
hit AS (
  SELECT session_id, source_id, payload_id, len(parts) - 1 AS hits, i,
    CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + (i - 1) * strlen(source) AS BIGINT) AS start, strlen(source) AS width
  FROM piece, unnest(range(1, len(parts))) AS u(i))"""


#: Each session's first event, and the place of its conversation among five.
FIRST = "first AS (SELECT session_id, conv_id % 5 AS no FROM ctx WHERE producer_seq = 0)"
PROV = """
claim AS (
  SELECT e.session_id, e.event_id AS "to", e.parent AS "from", p.event_id IS NULL AS gone, p.session_id AS other,
    coalesce(p.observation IN ('payload', 'dispatch'), false) AS answers,
    p.session_id = e.session_id AND p.request_id = e.request_id AS same, false AS lineage
  FROM ctx e LEFT JOIN ctx p ON p.event_id = e.parent WHERE e.parent IS NOT NULL
  UNION ALL SELECT e.session_id, e.event_id, u.a, p.event_id IS NULL, p.session_id, false, true, true
  FROM ctx e, unnest(string_split(e.lineage, ',')) AS u(a) LEFT JOIN ctx p ON p.event_id = u.a WHERE e.lineage IS NOT NULL),
verdict AS (
  SELECT *, CASE WHEN answers AND NOT same THEN 'response_request_mismatch' WHEN gone THEN 'missing_parent'
    WHEN other <> session_id THEN 'cross_session_link' END AS issue,
    CASE WHEN lineage THEN 'summary_ancestor' WHEN answers THEN 'response_to' ELSE 'recorded_parent' END AS kind FROM claim),
clash AS (SELECT payload_id, start, width, count(*) AS c FROM hit GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


def _context_sql() -> dict[str, str]:
    ctx = _ctx()
    shown = """session_id, event_id, producer_seq, request_id, attempt_id, observation, evidence, boundary, coverage, source_category,
      source_alias, source_key, content_version_key, estimated_tokens, byte_count, char_count, match_method, tool_call_id,
      usage_input_tokens, usage_output_tokens"""
    gap = """gap AS (
        SELECT session_id, request_id, max(producer_seq) AS top, arg_max(wall_time, producer_seq) AS wall_time FROM ctx WHERE type <> 'usage'
        GROUP BY 1, 2 HAVING NOT bool_or(type = 'payload'))"""
    phase = """phased AS (
        SELECT *, CASE WHEN type = 'response' THEN 'outcome' WHEN type = 'payload' THEN 'boundary'
          WHEN type IN ('compaction', 'tool_result', 'tool_call') THEN 'process' ELSE 'input' END AS phase FROM ctx WHERE type <> 'usage')"""
    title = """CASE WHEN type = 'response' THEN 'Assistant response'
        WHEN type = 'payload' THEN CASE WHEN observation = 'dispatch' THEN 'Provider dispatch' ELSE 'Provider request snapshot' END
        WHEN type IN ('tool_call', 'tool_result') THEN 'f' || turn || '.py: L' || range_start || '–L' || range_end
        WHEN type = 'compaction' THEN 'compaction_summary · range unknown' WHEN type = 'prompt' THEN 'User input'
        WHEN type = 'system_prompt' THEN 'Assembled system prompt' WHEN type = 'context_file' THEN 'Instructions: AGENTS.md'
        WHEN type = 'skill' THEN 'Skill: ' || source_alias ELSE source_alias END"""
    path = """CASE WHEN type IN ('tool_call', 'tool_result', 'context_file') THEN source_alias
        WHEN type = 'skill' THEN '/home/u/skill.md' ELSE source_key END"""
    order = "row_number() OVER (PARTITION BY session_id ORDER BY producer_seq)"
    line = """'{"event_id":"' || event_id || '","producer_seq":' || producer_seq || ',"content_version_key":' ||
        coalesce('"' || content_version_key || '"', 'null') || '}'"""
    roll = """rolled AS (
        SELECT conv_id, turn, role, text, j.k, j.shape, j.starts FROM conversations, unnest([
          {'k': 0, 'shape': CASE WHEN turn = 0 THEN 'meta' END, 'starts': 0},
          {'k': 1, 'shape': CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'start' END, 'starts': 1},
          {'k': 2, 'shape': CASE WHEN role = 'user' AND text <> '' THEN 'user' WHEN role = 'assistant' AND text <> '' THEN 'answer' ELSE 'silent' END, 'starts': 0},
          {'k': 3, 'shape': CASE WHEN role = 'assistant' THEN 'usage' END, 'starts': 0},
          {'k': 4, 'shape': CASE WHEN role = 'assistant' AND conv_id % 9 = 0 THEN 'drop' END, 'starts': 0}]) AS u(j) WHERE j.shape IS NOT NULL),
      scan AS (
        SELECT *, CAST(sum(starts) OVER w AS BIGINT) AS t, CAST(sum(CASE WHEN shape IN ('start', 'silent') THEN 0 ELSE 1 END) OVER w AS BIGINT) AS producer_seq,
          CAST(sum(CASE WHEN shape = 'drop' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS dropped FROM rolled
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, k)),
      owned AS (
        SELECT *, last_value(CASE WHEN shape = 'user' THEN producer_seq END IGNORE NULLS) OVER (
          PARTITION BY conv_id, t ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_seq,
          'codex:' || conv_id || ':t' || greatest(t, 1) AS req FROM scan),
      codex AS (SELECT * FROM owned WHERE shape NOT IN ('start', 'silent'))"""
    hook = """hooks AS (
        SELECT 'u' || user_id AS session_id, event_id AS seq, event_type AS t, value, props, CASE event_type WHEN 'click' THEN 'PreToolUse' WHEN 'purchase' THEN 'PostToolUse' WHEN 'view' THEN 'UserPromptSubmit'
          WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'SessionStart' ELSE 'PreCompact' END
          ELSE CASE WHEN event_id % 2 = 0 THEN 'Stop' ELSE 'Elsewhere' END END AS b, 'tool' || (event_id % 3) AS tool FROM events),
      asked AS (SELECT *, 'claude:' || session_id || ':' || b || ':' || seq AS req, 'prompt ' || value AS prompt FROM hooks)"""
    tool = "CASE WHEN l_linenumber IN (1, 2) THEN 'Read' WHEN l_linenumber = 3 THEN 'edit' WHEN l_linenumber IN (4, 5) THEN 'grep' ELSE 'bash' END"
    docs = """d AS (SELECT source AS session_id, lang AS request_id, doc_id AS seq, text, strlen(text) AS b FROM documents),
      kept AS (SELECT *, row_number() OVER (PARTITION BY session_id, request_id ORDER BY seq) AS no FROM d WHERE text <> ''),
      sized AS (SELECT *, strlen('{"' || CASE WHEN seq % 2 = 0 THEN 'input' ELSE 'other' END || '":' || CAST(to_json(text) AS VARCHAR) || '}') AS pb FROM d)"""
    out = {
        "context_events": _with(ctx, select=f"""SELECT {shown}, coalesce(parent, '') AS parents, coalesce(lineage, '') AS lineage,
              range_start, range_end FROM ctx"""),
        "event_query": _with(ctx, select="SELECT session_id, event_id, producer_seq, request_id, usage_input_tokens FROM ctx WHERE type = 'usage'"),
        "event_index": _with(ctx, select="SELECT session_id, count(*) AS events FROM ctx GROUP BY 1"),
        "event_lookup": _with(ctx, "top AS (SELECT source_key FROM ctx WHERE source_key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source_key DESC LIMIT 1)",
            select="SELECT session_id, event_id, producer_seq, source_key FROM ctx JOIN top USING (source_key)"),
        "event_index_digest": _with(ctx, f"""leaf AS (SELECT session_id, producer_seq // 4096 AS b, sha256(string_agg(sha256({line}), '' ORDER BY producer_seq)) AS d FROM ctx GROUP BY 1, 2)""",
            "mid AS (SELECT session_id, b // 4096 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM leaf GROUP BY 1, 2)",
            select="SELECT session_id, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM mid GROUP BY 1"),
        "default_ancestors": _with(ctx, f"""numbered AS (SELECT session_id, event_id, type, {order} AS n FROM ctx)""",
            select="""SELECT a.event_id, coalesce(string_agg(b.event_id, ',' ORDER BY b.n), '') AS lineage FROM numbered a
              LEFT JOIN numbered b ON b.session_id = a.session_id AND b.n BETWEEN a.n - 8 AND a.n - 1 WHERE a.type = 'usage' GROUP BY 1"""),
        "codex_ingest": _with(roll, select=f"""SELECT CAST(conv_id AS VARCHAR) AS session_id, producer_seq, CASE WHEN shape <> 'drop' THEN req END AS request_id,
              CASE shape WHEN 'meta' THEN 'inventory' WHEN 'user' THEN 'load' WHEN 'answer' THEN 'response' WHEN 'usage' THEN 'usage' ELSE 'capture_health' END AS observation,
              'transcript.' || CASE shape WHEN 'meta' THEN 'session_meta' WHEN 'user' THEN 'user_message' WHEN 'answer' THEN 'assistant_message'
                WHEN 'usage' THEN 'token_count' ELSE 'parse_error' END AS boundary,
              CASE WHEN shape = 'usage' THEN 'full' ELSE 'partial' END AS coverage,
              CASE shape WHEN 'meta' THEN 'codex_session' WHEN 'user' THEN 'user_prompt' WHEN 'answer' THEN 'codex_assistant_unknown' END AS source_alias,
              CASE shape WHEN 'meta' THEN {_keyed('session', "'s' || conv_id")} WHEN 'user' THEN {_keyed('user_input', "'i' || turn")}
                WHEN 'answer' THEN {_keyed('model_output', "'i' || turn")} END AS source_key,
              CASE WHEN shape IN ('user', 'answer') THEN {_version('text')} END AS content_version_key,
              CASE WHEN shape IN ('user', 'answer') THEN CAST(strlen(text) AS BIGINT) END AS byte_count,
              CASE WHEN shape = 'drop' THEN dropped END AS dropped_events,
              CASE WHEN shape = 'usage' THEN CAST(turn AS DOUBLE) END AS usage_input_tokens,
              CASE WHEN shape = 'usage' THEN CAST(turn * 2 AS DOUBLE) END AS usage_output_tokens,
              shape = 'answer' AND asked_seq IS NOT NULL AS answers_user FROM codex"""),
        "turn_assignment": _with(roll, select="""SELECT CAST(conv_id AS VARCHAR) AS session_id, producer_seq, req AS request_id, asked_seq
              FROM codex WHERE shape = 'answer'"""),
        "codex_history": f"""WITH h AS (SELECT 'c' || conv_id AS session_id, turn AS producer_seq, 'codex-hist:c' || conv_id || ':' || turn AS request_id, text
            FROM conversations WHERE role = 'user' AND text <> '')
          SELECT session_id, producer_seq, request_id, {_keyed('user_input', 'request_id')} AS source_key, {_version('text')} AS content_version_key,
            {_tokens('text')} AS estimated_tokens FROM h""",
        "claude_ingest": _with(hook, select=f"""SELECT session_id, seq AS producer_seq, req AS request_id,
              CASE b WHEN 'SessionStart' THEN 'inventory' WHEN 'PostToolUse' THEN 'read' WHEN 'PreCompact' THEN 'transform'
                WHEN 'Stop' THEN 'capture_health' WHEN 'Elsewhere' THEN 'capture_health' ELSE 'load' END AS observation,
              CASE b WHEN 'SessionStart' THEN 'inventoried' WHEN 'PostToolUse' THEN 'read_result' WHEN 'PreCompact' THEN 'summary_ancestor'
                WHEN 'Stop' THEN 'unknown' WHEN 'Elsewhere' THEN 'unknown' ELSE 'runtime_loaded' END AS evidence, b AS boundary,
              CASE b WHEN 'Stop' THEN 'unsupported' WHEN 'Elsewhere' THEN 'unknown' ELSE 'partial' END AS coverage,
              CASE b WHEN 'SessionStart' THEN 'other' WHEN 'PreToolUse' THEN 'other' WHEN 'PostToolUse' THEN 'tool_result'
                WHEN 'UserPromptSubmit' THEN 'user_input' WHEN 'PreCompact' THEN 'summary' END AS source_category,
              CASE b WHEN 'SessionStart' THEN 'claude_session' WHEN 'PreToolUse' THEN tool WHEN 'PostToolUse' THEN tool
                WHEN 'UserPromptSubmit' THEN 'user_prompt' WHEN 'PreCompact' THEN 'precompact' END AS source_alias,
              CASE b WHEN 'SessionStart' THEN {_keyed('session', 'session_id')} WHEN 'PreToolUse' THEN {_keyed('tool_call', "tool || ':' || req")}
                WHEN 'PostToolUse' THEN {_keyed('tool_result', "tool || ':' || req")} WHEN 'UserPromptSubmit' THEN {_keyed('user_input', 'req')}
                WHEN 'PreCompact' THEN {_keyed('summary', 'req')} END AS source_key,
              CASE b WHEN 'PostToolUse' THEN {_version('props')} WHEN 'UserPromptSubmit' THEN {_version('prompt')} END AS content_version_key,
              CAST(CASE b WHEN 'PostToolUse' THEN strlen(props) WHEN 'UserPromptSubmit' THEN strlen(prompt) END AS BIGINT) AS byte_count,
              CASE WHEN b IN ('Stop', 'Elsewhere') THEN b END AS unsupported_boundary FROM asked"""),
        "tool_ranges": f"""WITH a AS (
            SELECT {tool} AS tool, l_linenumber AS n, CASE WHEN l_partkey % 3 <> 0 THEN '/src/' || l_partkey END AS p,
              CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS o, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INT) END AS l FROM lineitem),
          r AS (SELECT *, tool = 'Read' AND o IS NOT NULL AND l IS NOT NULL AS ranged FROM a)
          SELECT tool, coalesce(p, CASE WHEN n = 4 THEN 'pattern:TODO' END) AS path, CASE WHEN ranged THEN o END AS start,
            CASE WHEN ranged THEN o + l - 1 END AS end, CASE WHEN ranged THEN 'runtime_line_range' END AS match_method,
            CASE tool WHEN 'edit' THEN 'transform' WHEN 'bash' THEN 'load' ELSE 'read' END AS observation,
            CASE WHEN ranged AND p IS NOT NULL THEN 'full' ELSE 'partial' END AS coverage, count(*) AS calls FROM r GROUP BY ALL""",
        "payload_fields": _with(ctx, select="""SELECT event_id, '/messages/0/content/0/text' AS pointer,
              CAST(strlen(text || ' / ' || text) AS BIGINT) AS bytes, sha256(text || ' / ' || text) AS text_sha FROM ctx WHERE type = 'payload'"""),
        "text_matches": _with(ctx, _match_parts(), select="""SELECT source_id, payload_id, '/messages/0/content/0/text' AS pointer,
              CAST(hits AS INT) AS hits, start, CAST(start + width AS BIGINT) AS end FROM hit"""),
        "containment": """WITH p AS (
            SELECT item_id, doc_id, b.text AS s, string_split(d.text, b.text) AS parts FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
          h AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + (i - 1) * strlen(s) AS BIGINT) AS start
            FROM p, unnest(range(1, len(parts))) AS u(i))
          SELECT item_id, doc_id, CAST(i - 1 AS INT) AS hit_no, start, CAST(start + strlen(s) AS BIGINT) AS end FROM h""",
        "containment_short": """WITH w AS (SELECT item_id, text, string_split(text, ' ') AS ws FROM benchmark),
          q AS (SELECT DISTINCT item_id, unnest([array_to_string(ws[1:3], ' '), array_to_string(ws[1:2], ' '), substr(text, 1, 3) || '. ']) AS s FROM w),
          p AS (SELECT item_id, doc_id, s, string_split(d.text, s) AS parts FROM documents d JOIN q ON contains(d.text, s) WHERE s <> ''),
          h AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + (i - 1) * strlen(s) AS BIGINT) AS start
            FROM p, unnest(range(1, len(parts))) AS u(i))
          SELECT item_id, doc_id, start, count(*) AS sources, CAST(sum(strlen(s)) AS BIGINT) AS bytes FROM h GROUP BY 1, 2, 3""",
        "recent_sources": """WITH s AS (
            SELECT conv_id, turn, role, count(*) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)
          SELECT p.conv_id || '-' || p.turn AS payload_id, q.conv_id || '-' || q.turn AS source_id, CAST(q.no AS BIGINT) AS source_no
          FROM s p JOIN s q ON q.conv_id = p.conv_id AND q.role <> 'assistant' AND q.no BETWEEN p.no - 7 AND p.no WHERE p.role = 'assistant'""",
        "match_health": _with(docs, select="""SELECT session_id, request_id, 'source_matching.eviction' AS boundary, count(*) AS rows FROM kept WHERE no > 8 GROUP BY 1, 2
            UNION ALL SELECT session_id, request_id, 'source_matching.unsupported_text_layout', count(*) FROM sized
              WHERE seq % 2 = 1 GROUP BY 1, 2"""),
        "prov_nodes": _with(ctx, select="""SELECT event_id AS id, CASE observation WHEN 'response' THEN 'response' WHEN 'payload' THEN 'request'
                WHEN 'dispatch' THEN 'request' WHEN 'transform' THEN 'transform' WHEN 'usage' THEN 'telemetry' ELSE 'source' END AS kind,
              CASE source_category WHEN 'system_input' THEN 'System input' WHEN 'user_input' THEN 'User input' WHEN 'unattributed' THEN 'Unattributed'
                WHEN 'summary' THEN 'Summary' WHEN 'tool_result' THEN 'Tool result' WHEN 'model_output' THEN 'Model response'
                WHEN 'other' THEN 'Runtime resource' WHEN 'skill' THEN 'Skill' WHEN 'instructions' THEN 'Instructions' ELSE 'Observation' END AS category,
              coalesce(source_alias, observation) AS label, session_id, 'agent-main' AS agent_id, request_id, attempt_id, observation FROM ctx"""),
        "prov_edges": _with(ctx, _match_parts(), PROV, select="""SELECT session_id, "from", "to", kind, false AS ambiguous, count(*) AS edges
              FROM verdict WHERE issue IS NULL GROUP BY ALL
            UNION ALL SELECT h.session_id, source_id, payload_id, 'observed_text_match', c.c IS NOT NULL, count(*)
              FROM hit h LEFT JOIN clash c USING (payload_id, start, width) GROUP BY ALL"""),
        "prov_issues": _with(ctx, _match_parts(), PROV, select="""SELECT session_id, code, count(*) AS issues FROM (
              SELECT session_id, issue AS code FROM verdict WHERE issue IS NOT NULL
              UNION ALL SELECT session_id, 'capture_gap' FROM ctx WHERE coverage <> 'full'
              UNION ALL SELECT h.session_id, 'capture_gap' FROM hit h JOIN ctx p ON p.event_id = h.payload_id WHERE p.coverage <> 'full'
              UNION ALL SELECT session_id, 'ambiguous_match' FROM hit JOIN clash USING (payload_id, start, width)) GROUP BY 1, 2"""),
        "ambiguous_matches": _with(ctx, _match_parts(), PROV, select="""SELECT source_id AS "from", payload_id AS "to" FROM hit JOIN clash USING (payload_id, start, width)"""),
        "request_inspection": _with(ctx, _match_parts(), PROV,
            """up AS (SELECT DISTINCT "to" AS a, "from" AS b FROM verdict WHERE issue IS NULL AND kind = 'summary_ancestor')""",
            """anc AS (SELECT DISTINCT payload_id AS request, source_id AS a FROM hit UNION SELECT request, b FROM anc JOIN up USING (a))""",
            "pool AS (SELECT session_id, count(*) AS c FROM ctx WHERE observation IN ('load', 'read', 'transform') GROUP BY 1)",
            "m AS (SELECT payload_id AS request, count(*) AS n, count(DISTINCT source_id) AS s FROM hit GROUP BY 1)",
            """r AS (SELECT "from" AS request, count(*) AS n FROM verdict WHERE issue IS NULL AND kind = 'response_to' GROUP BY 1)""",
            "g AS (SELECT request, count(*) AS n FROM anc GROUP BY 1)",
            "u AS (SELECT session_id, request_id, count(*) AS n, sum(usage_output_tokens) AS o FROM ctx WHERE type = 'usage' GROUP BY 1, 2)",
            select="""SELECT q.session_id, q.event_id AS request, coalesce(m.n, 0) AS matches, coalesce(r.n, 0) AS responses, coalesce(g.n, 0) AS ancestors,
              coalesce(pool.c, 0) AS candidates, coalesce(pool.c, 0) - coalesce(m.s, 0) AS unmatched, coalesce(u.n, 0) AS usage_rows, u.o AS usage_output,
              CASE WHEN r.n > 0 THEN 'Response observed; semantic influence unknown' ELSE 'Output not recorded' END AS output_status
              FROM ctx q LEFT JOIN m ON m.request = q.event_id LEFT JOIN r ON r.request = q.event_id LEFT JOIN g ON g.request = q.event_id
              LEFT JOIN pool USING (session_id) LEFT JOIN u ON u.session_id = q.session_id AND u.request_id = q.request_id WHERE q.type = 'payload'""",
            recursive=True),
        "request_list": _with(ctx, select="SELECT session_id, event_id AS id, request_id AS label, attempt_id AS attempt FROM ctx WHERE type = 'payload'"),
        "capture_problems": "SELECT DISTINCT 'c' || conv_id AS session_id FROM conversations WHERE conv_id % 5 = 0 AND turn = 0 AND role IN ('user', 'system')",
        "context_scan": _with(ctx, FIRST, select="""SELECT 'valid' AS reason, (SELECT count(*) FROM ctx) + count(*) AS rows FROM first WHERE no IN (0, 4)
            UNION ALL SELECT CASE no WHEN 1 THEN 'wrong_schema' WHEN 2 THEN 'missing_field' ELSE 'malformed_row' END, count(*) FROM first
              WHERE no IN (1, 2, 3) GROUP BY 1"""),
        "admitted_graph": _with(ctx, PROV, FIRST,
            "refused AS (SELECT session_id, CASE no WHEN 0 THEN 'repeated_event_id' ELSE 'unknown_observation' END AS reason FROM first WHERE no IN (0, 4))",
            "n AS (SELECT session_id, count(*) AS nodes FROM ctx GROUP BY 1)",
            "e AS (SELECT session_id, count(*) AS edges FROM verdict WHERE issue IS NULL GROUP BY 1)",
            """i AS (SELECT session_id, count(*) AS issues FROM (SELECT session_id FROM verdict WHERE issue IS NOT NULL
              UNION ALL SELECT session_id FROM ctx WHERE coverage <> 'full') GROUP BY 1)""",
            select="""SELECT session_id, CASE WHEN reason IS NULL THEN nodes ELSE 0 END AS nodes, CASE WHEN reason IS NULL THEN coalesce(edges, 0) ELSE 0 END AS edges,
              CASE WHEN reason IS NULL THEN coalesce(issues, 0) ELSE 0 END AS issues, reason
              FROM n LEFT JOIN refused USING (session_id) LEFT JOIN e USING (session_id) LEFT JOIN i USING (session_id)"""),
        "request_sources": _with(ctx, _match_parts(), select="""SELECT q.session_id, q.request, c.event_id AS id, bool_or(h.source_id IS NOT NULL) AS matched
              FROM (SELECT session_id, arg_max(event_id, producer_seq) AS request FROM ctx WHERE type = 'payload' GROUP BY 1) q
              JOIN ctx c ON c.session_id = q.session_id AND c.observation IN ('load', 'read', 'transform')
              LEFT JOIN hit h ON h.payload_id = q.request AND h.source_id = c.event_id GROUP BY ALL"""),
        "activity_steps": _with(ctx, phase, gap, select=f"""SELECT session_id, event_id, CAST(producer_seq AS DOUBLE) AS seq, wall_time, phase, 'pi' AS agent_runtime,
              {title} AS title, {path} AS path, CASE WHEN tool_call_id IS NOT NULL THEN source_alias END AS tool_name, request_id, coverage, boundary,
              false AS derived, range_start, CASE WHEN range_start IS NOT NULL THEN 'line' END AS range_unit FROM phased
            UNION ALL SELECT session_id, 'derived:gap:' || request_id, top + 0.5, wall_time, 'health', 'pi', 'Capture gap: no provider payload snapshot', NULL, NULL,
              request_id, 'unsupported', 'capture_health.missing_provider_payload', true, NULL, NULL FROM gap"""),
        "activity_order": _with(ctx, phase, gap, """every AS (SELECT session_id, event_id, CAST(producer_seq AS DOUBLE) AS seq, wall_time, phase, false AS derived FROM phased
              UNION ALL SELECT session_id, 'derived:gap:' || request_id, top + 0.5, wall_time, 'health', true FROM gap)""",
            select="""SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, wall_time, derived, event_id) AS position, phase FROM every"""),
        "activity_counts": _with(ctx, phase, gap, "every AS (SELECT session_id, phase FROM phased UNION ALL SELECT session_id, 'health' FROM gap)",
            select="SELECT session_id, count(*) AS steps, " + ", ".join(
                f"count(*) FILTER (phase = '{p}') AS {p}" for p in ("input", "process", "boundary", "outcome", "health")) + " FROM every GROUP BY 1"),
        "activity_gaps": _with(ctx, gap, select="SELECT session_id, request_id, CAST(top + 0.5 AS DOUBLE) AS seq, wall_time FROM gap"),
        "turn_order": _with(ctx, select="""SELECT session_id, request_id, row_number() OVER (PARTITION BY session_id ORDER BY first) AS turn_no FROM (
              SELECT session_id, request_id, min(producer_seq) AS first FROM ctx WHERE type <> 'usage' GROUP BY 1, 2)"""),
        "seam_export": _with(ctx, select="""SELECT event_id AS id, coalesce(parent, split_part(lineage, ',', 1)) AS parent_id, coalesce(parent, lineage, '') AS parent_ids,
              coalesce(parent || '=response_to', array_to_string(list_sort(list_transform(string_split(lineage, ','), lambda x: x || '=summary_ancestor')), ','), '') AS relations,
              'context_' || observation AS kind, source_category AS role, source_alias AS name, false AS is_error,
              CAST(CASE WHEN type = 'usage' THEN 2 ELSE 0 END AS BIGINT) AS counters, session_id, source_key FROM ctx"""),
        "seam_sink": _with(ctx, select="""SELECT session_id, relation, count(*) AS edges FROM (
              SELECT session_id, 'response_to' AS relation FROM ctx WHERE parent IS NOT NULL
              UNION ALL SELECT session_id, 'summary_ancestor' FROM ctx, unnest(string_split(lineage, ',')) AS u(a) WHERE lineage IS NOT NULL) GROUP BY 1, 2"""),
        "provenance_join": _with(ctx, select="""SELECT event_id, session_id, request_id, observation, evidence, coverage, boundary, 'pi' AS adapter_id
              FROM ctx WHERE type <> 'usage'"""),
        "provenance_join_strict": _with(ctx, select="""SELECT event_id, session_id, request_id, 'context_' || observation AS kind, evidence, coverage, boundary
              FROM ctx WHERE type = 'response'"""),
        "safe_projection": _with(ctx, select="""SELECT event_id, CASE WHEN type IN ('tool_call', 'tool_result') THEN 'f' || turn || '.py'
              WHEN type = 'context_file' THEN 'AGENTS.md' ELSE source_alias END AS source_alias, CAST(NULL AS VARCHAR) AS raw_text,
              CAST(NULL AS VARCHAR) AS source_path, true AS raw_text_redacted, range_start AS start FROM ctx"""),
        "stream_tail": _with(ctx, select="SELECT session_id, event_id, producer_seq, observation, byte_count FROM ctx"),
        "stream_late": _with(ctx, "times AS (SELECT max(strptime(wall_time, '%Y-%m-%dT%H:%M:%SZ')) AS newest FROM ctx)",
            select="""SELECT session_id, event_id, producer_seq, CASE WHEN strptime(wall_time, '%Y-%m-%dT%H:%M:%SZ') >= newest - INTERVAL 10 SECOND
              THEN 'on_time' ELSE 'behind_watermark' END AS dealt FROM ctx, times"""),
        "stream_unique": _with(ctx, select="SELECT session_id, event_id, producer_seq FROM ctx"),
        "stream_sources": _with(ctx, """src AS (SELECT *, row_number() OVER (PARTITION BY session_id, request_id ORDER BY producer_seq) AS no FROM ctx
              WHERE type IN ('prompt', 'system_prompt'))""", """near AS (
              SELECT s.session_id, s.request_id, p.event_id AS payload_id, s.event_id AS source_id, s.no AS source_no,
                row_number() OVER (PARTITION BY p.event_id ORDER BY s.no DESC) AS back FROM ctx p JOIN src s
              ON s.session_id = p.session_id AND s.request_id = p.request_id AND s.producer_seq < p.producer_seq WHERE p.type = 'payload')""",
            select="SELECT session_id, request_id, payload_id, source_id, source_no FROM near WHERE back <= 8"),
        "stream_drops": _with(roll, select="""SELECT CAST(conv_id AS VARCHAR) AS session_id, producer_seq AS seq, CAST(1 AS BIGINT) AS dropped,
              dropped AS cumulative FROM codex WHERE shape = 'drop'"""),
    }
    gaps = _with(ctx, """firsts AS (SELECT session_id, request_id, min(producer_seq) FILTER (type = 'payload') AS p,
          min(producer_seq) FILTER (type IN ('tool_call', 'tool_result')) AS t FROM ctx GROUP BY 1, 2)""", """late AS (
          SELECT c.session_id, c.request_id, c.producer_seq AS seq, c.event_id, coalesce(t > c.producer_seq, true) AS no_tool
          FROM ctx c JOIN firsts USING (session_id, request_id) WHERE c.type = 'response' AND coalesce(p > c.producer_seq, true))""",
        select="""SELECT session_id, request_id, seq, event_id, 'capture_health.missing_provider_payload' AS boundary FROM late
          UNION ALL SELECT session_id, request_id, seq, event_id, 'capture_health.missing_tool_events' FROM late WHERE no_tool""")
    return out | {"stream_gaps": gaps, "stream_gaps_batch": gaps}


def sql() -> dict[str, str]:
    """Oracle text per query."""
    return {**_findings_sql(), **_text_sql(), **_ingest_sql(), **_report_sql(), **_graph_sql(), **_context_sql()}
