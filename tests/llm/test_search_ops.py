"""Decontamination, hard negatives and spelling variants against brute force and SQL, with the awkward cases."""

import itertools
import random
import zlib

import duckdb
import pytest
from helpers import AWKWARD, by_id, clash, docs, given

from tracelode.llm import decontaminate, hard_negatives, oracles, spelling


def from_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas())
    return con.execute(sql).fetchall()


# --- benchmark decontamination ------------------------------------------------

def words_of(text):
    import re

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded) if w]


def brute_hits(texts, items, span=10):
    windows = {}
    for item_id, text in items:
        w = words_of(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(item_id)
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def bench_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontaminate_equals_brute_force(spark):
    draw = random.Random(5)
    vocabulary = "ab cd ef gh".split()
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, some(14)), (2, some(11)), (2, some(10)), (3, some(9)), (4, "Zz!"), (5, some(3)), (6, None), (7, ""), (None, some(12)),
             (8, "same " * 40), (10, some(14)), (11, "same " * 10)]
    items.append((9, items[0][1]))
    texts = [*AWKWARD, *(some(draw.randint(0, 200)) for _ in range(30)), "x " + items[0][1].upper() + "; y", "zz", "same " * 300, "q " + "same " * 9,
             items[2][1][:-1]]
    found = by_id(decontaminate.scan(clash(docs(spark, texts)), clash(bench_table(spark, items)).drop("kept")))
    for i, (n, hit, ids) in enumerate(brute_hits(texts, items)):
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["item_ids"]) == (n, hit, ids), texts[i]
        assert sum(s["end"] - s["start"] for s in found[i]["spans"]) == hit
    assert sum(row["n_hit"] > 0 for row in found.values()) > 20


def test_decontaminate_equals_sql_with_repeats(spark):
    table = given(spark)
    table = table.unionByName(table.limit(5)).unionByName(docs(spark, [None, "", "a"], ids=[None, None, 7]))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = sorted(decontaminate.scan(table, items).selectExpr("doc_id", "n_words", "n_hit", "size(item_ids)").collect(), key=str)
    other = from_sql(f"SELECT doc_id, n_words, n_hit, n_items FROM ({oracles.op11()})", documents=table, benchmark=items)
    plain = lambda rows: sorted(tuple(-1 if x is None or x != x else int(x) for x in row) for row in rows)
    assert plain(found) == plain(other)
    assert any(row["n_hit"] for row in found)


def test_decontaminate_empty_tables(spark):
    texts, nothing = docs(spark, ["a b c"]), bench_table(spark, [(1, None)])
    assert [tuple(r)[:3] for r in decontaminate.scan(texts, nothing).collect()] == [(0, 3, 0)]
    assert decontaminate.scan(texts.limit(0), bench_table(spark, [(1, "a b")])).count() == 0
    assert decontaminate.scan(texts, nothing.limit(0)).count() == 1


@pytest.mark.parametrize("m", range(1, 11))
def test_every_shared_span_keeps_a_shared_fingerprint(spark, m):
    draw = random.Random(m)
    span = [str(draw.randint(0, 3)) for _ in range(m)]
    rows = [(i, [*map(str, draw.choices(range(4), k=draw.randint(0, 9))), *span, *map(str, draw.choices(range(4), k=5))]) for i in range(20)]
    table = spark.createDataFrame([*rows, (99, span)], "id int, w array<string>")
    prints = decontaminate.fingerprints(table, [m], ["id"]).groupBy("id").agg({"print": "collect_set"}).collect()
    own = {r[0]: set(r[1]) for r in prints}
    assert all(own[99] & own[i] for i in range(20))


# --- hard negatives -------------------------------------------------------------

def whole_number(x):
    import math

    return math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256


def brute_negatives(rows):
    import math

    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [whole_number(x) for x in v]))
    long = lambda s: max(min(s, 2**63 - 1), -2**63)
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(long(sum(x * y for x, y in zip(v, w, strict=False))), i, lab) for k, (i, lab, w) in enumerate(kept) if k != a]
        for top, positive, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            fits = sorted((x for x in scored if x[2] != label and 80 * top <= 100 * x[0] <= 100 * top), key=order)[:5]
            out += [(anchor, positive, rank, i, top, s) for rank, (s, i, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, embedding array<double>"


def mined(spark, rows, monkeypatch, block=7, group=2):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", group)
    table = clash(spark.createDataFrame(rows, VECTORS)).withColumnRenamed("n", "uid").withColumnRenamed("w", "block")
    return sorted(map(tuple, hard_negatives.mine(table).collect()), key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    vector = lambda: [draw.choice([-1.0, -.5, -.25, 0.0, .25, .5, .75, .999]) for _ in range(11)]
    rows = [(i * 25, draw.choice([0, 1, 1, 1, 2]), vector()) for i in range(40)]
    rows += [(2, None, vector()), (3, 1, None), (4, 1, [None] * 11), (5, 1, [float("nan")] * 11), (6, 1, [float("inf")] * 11)]
    rows += [(None, 1, vector()), (8, 2, vector()[:3]), (9, 0, []), (-100, 1, vector()), rows[4], rows[5], (11, 2, rows[4][2])]
    got = mined(spark, rows, monkeypatch)
    assert got == brute_negatives(rows) and len(got) > 40


def test_hard_negatives_of_large_components(spark, monkeypatch):
    rows = [(100, 1, [1e30, 2.0]), (1, 1, [1e-28, 1.0]), (2, 2, [1e-28, .9]), (3, 2, [2e20, 1.0]), (4, 1, [3e38, 1.0]), (5, 1, [-3e38, 1.0])]
    assert mined(spark, rows, monkeypatch) == brute_negatives(rows)


def test_hard_negatives_of_no_rows(spark, monkeypatch):
    assert mined(spark, [(1, None, None)], monkeypatch) == []
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


# --- spelling variants ------------------------------------------------------------

def counted(texts):
    import re

    counts = {}
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(texts):
    counts = counted(texts)
    near = {w: sorted((-counts[x], x) for x in counts if x != w and apart(w, x)) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 5 * counts[w] else None for w in counts}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled(spark, texts, **how):
    table = spark.createDataFrame(texts, "doc_id long, text string")
    return sorted(map(tuple, spelling.variants(clash(table).withColumnRenamed("x", "cell").withColumnRenamed("h", "word"), **how).collect()), key=str)


@pytest.mark.parametrize("part_words", [4, 20_000])
def test_spelling_variants_equal_brute_force(spark, part_words):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcÉé") for _ in range(draw.randint(6, 8))) for _ in range(60)]
    base += [w[:i] + draw.choice(["", "d", "ab"]) + w[i + 1:] for w in base for i in (1, 3)]
    times = {w: draw.choice([1, 1, 2, 12, 80]) for w in base}
    texts = [(i, " ".join(w for w in base for _ in range(draw.randint(0, times[w])))) for i in range(25)]
    texts += [(None, "Missing × missing ÷ " * 3), (3, None), (3, ""), (4, "x" * 3000 + " " + "y" * 3000), *[(5, "z" * 400)] * 6, *[(6, "z" * 401)] * 40]
    got = spelled(spark, texts, part_words=part_words)
    assert got == brute_variants(texts)
    assert sum(r[1] is not None for r in got) > 3


def test_spelling_forms_are_followed(spark):
    texts = [(1, "abcdefg " * 5 + "abcdefgh " * 25 + "abcdefghi " * 125 + "abcdefghij " * 625)]
    found = {r[0]: r[2] for r in spelled(spark, texts)}
    assert found == {r[0]: r[2] for r in brute_variants(texts)} and found["abcdefg"] == "abcdefghij"


def test_spelling_of_no_rows(spark):
    assert spelled(spark, [(1, None)]) == []
    assert spelling.variants(docs(spark, ["x"]).limit(0)).count() == 0


def test_search_reaches_each_key_once():
    for top in itertools.product(range(3), repeat=3):
        keys = [(size, path) for size, path, _, _ in spelling.reached(8, top)]
        assert len(keys) == len(set(keys))
