r"""The same results as DuckDB SQL, where SQL can express an operator."""

from __future__ import annotations

from tracelode.llm import decontaminate, host_quality, license_scan

WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1(source: str = "documents", limit: float = host_quality.HOST_LIMIT) -> str:
    """Facts by document, rates by host, the fitted prior, verdicts."""
    rules = host_quality.RULES
    counts = ", ".join(f"sum(f_{r}::int)::double k_{r}" for r in rules)
    fit = ", ".join(
        f"avg(k_{r} / n) m_{r}, CASE WHEN var_pop(k_{r} / n) > 1e-12 THEN "
        f"least(greatest(avg(k_{r} / n) * (1 - avg(k_{r} / n)) / var_pop(k_{r} / n) - 1, 2.0), 1e4) ELSE 2.0 END s_{r}"
        for r in rules
    )
    shrunk = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) r_{r}" for r in rules)
    bad = " OR ".join(f"r_{r} - 2 * sqrt(r_{r} * (1 - r_{r}) / (n + s_{r} + 1)) > {limit}" for r in rules)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source AS host, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, {WORDS} AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM i),
c AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g),
p AS (SELECT row_id, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE n > 1),
q AS (SELECT row_id, count(DISTINCT pos) AS n FROM p GROUP BY row_id),
f AS (SELECT w.row_id, doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words
  FROM w LEFT JOIN q ON w.row_id = q.row_id),
r AS (SELECT *, n_words < {host_quality.MIN_WORDS} AS f_short,
  100 * n_repeat_words > {host_quality.MAX_REPEAT_PERCENT} * n_words AS f_repeats,
  100 * n_symbols > {host_quality.MAX_SYMBOL_PERCENT} * n_words AS f_symbols,
  100 * n_dup_lines > {host_quality.MAX_DUP_LINE_PERCENT} * n_lines AS f_dup_lines FROM f),
h AS (SELECT host, count(*)::double AS n, {counts} FROM r WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT {fit} FROM h),
s AS (SELECT host, n, {", ".join(f"s_{r}" for r in rules)}, {shrunk} FROM h CROSS JOIN b),
v AS (SELECT host FROM s WHERE {bad})
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
  n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
  f_short OR f_repeats AS base_failed, NOT (f_short OR f_repeats) AND v.host IS NULL AS kept,
  v.host IS NOT NULL AS host_condemned
FROM r LEFT JOIN v ON r.host = v.host"""


def op9(source: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM {source}),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g"""


def op4(source: str = "documents", percent: int = license_scan.THRESHOLD_PERCENT) -> str:
    """Phrases at every word, and containment of every template in every block."""
    tests, width = [], license_scan.BLOCK
    for phrase, label in license_scan.PHRASES.items():
        same = " AND ".join(f"ws[i + {k}] = '{token}'" for k, token in enumerate(phrase.split()))
        tests.append(f"SELECT row_id, i - 1 AS start, '{label}' AS label FROM i WHERE {same}")
    templates = ", ".join(f"({k}, '{family}', '{label}', '{text}')" for k, (family, label, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id,
  translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}') AS t FROM {source}),
w AS (SELECT row_id, doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
i AS (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS ({" UNION ALL ".join(tests)}),
b AS (SELECT row_id, count(*) AS n, min(start) AS lo, max(start) AS hi FROM p GROUP BY row_id),
t AS (SELECT family, label, list_distinct(string_split(words, ' ')) AS tokens FROM (VALUES {templates}) v(k, family, label, words)),
k AS (SELECT row_id, j, list_distinct(ws[j + 1:j + {width}]) AS block
  FROM (SELECT row_id, ws, unnest(range(0, greatest(len(ws), 1), {width // 2})) AS j FROM w)),
h AS (SELECT row_id, j, family, label, len(list_intersect(block, tokens)) AS c, len(tokens) AS n FROM k, t
  WHERE list_has_any(block, tokens)),
m AS (SELECT row_id, label, c / n AS share FROM h WHERE 100 * c >= {percent} * n
  QUALIFY rank() OVER (PARTITION BY row_id, j, family ORDER BY c / n DESC, c DESC) = 1),
s AS (SELECT row_id, max(share) AS best FROM m GROUP BY row_id),
o AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY row_id),
u AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row_id, label FROM p UNION SELECT row_id, label FROM m) GROUP BY row_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(b.n, 0)::bigint AS n_base, lo::bigint AS first_word, hi::bigint AS last_word,
  coalesce(o.labels, '') AS base_labels, coalesce(u.labels, '') AS labels,
  greatest(coalesce(s.best, 0), CASE WHEN b.n > 0 THEN 1 ELSE 0 END)::double AS score
FROM w LEFT JOIN b ON w.row_id = b.row_id LEFT JOIN o ON w.row_id = o.row_id
  LEFT JOIN u ON w.row_id = u.row_id LEFT JOIN s ON w.row_id = s.row_id"""


def op6(source: str = "documents", percent: int = 80) -> str:
    """Distinct shingles, overlaps of all pairs that share one, and the closure of the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM {source}),
w AS (SELECT doc_id, {WORDS} AS ws FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::bigint AS n_shingles, min(r.reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def op11(docs: str = "documents", items: str = "benchmark", span: int = decontaminate.SPAN) -> str:
    """Windows of items at every word of every document, by their words."""
    tokens = (rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), "
              rf"'{license_scan.NOT_WORD}'), lambda x: x <> '')")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {tokens} AS ws FROM {docs}),
b AS (SELECT item_id::varchar AS item_id, {tokens} AS ws FROM {items}),
m AS (SELECT *, least(len(ws), {span}) AS m FROM b WHERE len(ws) > 0),
k AS (SELECT item_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM m),
t AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM k),
l AS (SELECT DISTINCT m FROM t),
p AS (SELECT row_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, l WHERE len(ws) >= m),
g AS (SELECT row_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w FROM p),
h AS (SELECT row_id, i, g.m, item_id FROM g JOIN t ON g.m = t.m AND g.w = t.w),
c AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY row_id),
o AS (SELECT row_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT row_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(c.n, 0)::bigint AS n_hit, coalesce(o.n, 0)::bigint AS n_items,
  sha256(coalesce(o.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.row_id = c.row_id LEFT JOIN o ON d.row_id = o.row_id"""


def op12(vectors: str = "embeddings") -> str:
    """All scores of all anchors, and their ranks."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM {vectors}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT uid AS a_uid, vec_id AS anchor_id, label AS a_label, q AS a_q FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a_uid, anchor_id, a_label, uid, vec_id, label, list_inner_product(a_q, q)::bigint AS score FROM a JOIN v ON a_uid <> uid),
p AS (SELECT a_uid, anchor_id, uid AS p_uid, vec_id AS positive_id, score AS positive_score FROM s WHERE label = a_label
  QUALIFY row_number() OVER (PARTITION BY a_uid ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a_uid, p_uid ORDER BY score DESC, vec_id NULLS LAST))::int AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a_uid = s.a_uid AND label <> a_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def op13(docs: str = "documents") -> str:
    """Runs counted after the deletions, words one letter apart by their deletions, and forms followed."""
    return rf"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range::bigint, range::bigint, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM {docs}),
f AS (SELECT doc_id, translate(run, '{license_scan.UPPER}', '{license_scan.LOWER}') AS run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) AS h FROM f),
y AS (SELECT run, n, list_transform(range(1, length(h), 2), lambda j: ('0x' || substring(h, j, 2))::bigint) AS bytes FROM x),
z AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295) AS crc FROM y, tab),
o AS (SELECT CASE WHEN crc % 199 = 0 THEN substring(run, 1, (crc % length(run))::int) || substring(run, (crc % length(run))::int + 2)
  ELSE run END AS word, n FROM z),
w AS (SELECT word, sum(n)::bigint AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS short FROM i),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.short = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.short = w.word),
k AS (SELECT word, count(*) AS n_near, max(m) AS top FROM e GROUP BY word),
b AS (SELECT e.word, min(other) AS best FROM e JOIN k ON e.word = k.word AND m = top GROUP BY e.word),
j AS (SELECT w.word, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN top >= 5 * n THEN best END AS form,
  CASE WHEN top >= 5 * n THEN top END AS form_n FROM w LEFT JOIN k ON w.word = k.word LEFT JOIN b ON w.word = b.word),
g(word, reached, depth) AS (SELECT word, word, 0 FROM j UNION ALL
  SELECT g.word, j.form, depth + 1 FROM g JOIN j ON j.word = g.reached WHERE j.form IS NOT NULL)
SELECT j.word, form, arg_max(g.reached, depth) AS root, n, n_near, form_n::bigint AS form_n FROM j JOIN g ON j.word = g.word GROUP BY ALL"""


def sql() -> dict[str, str]:
    return {"op1_host_quality": op1(), "op4_license_scan": op4(), "op6_ngram_jaccard": op6(), "op9_exact_dedup": op9(),
            "op11_decontaminate": op11(), "op12_hard_negatives": op12(), "op13_spelling_variants": op13()}
