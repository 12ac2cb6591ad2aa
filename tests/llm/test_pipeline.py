import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import SCHEMA
from test_jaccard_join import shingles
from test_models import brute_spans
from test_text_ops import brute_quality

from tracelode.session import work_path


def near_groups(rows):
    kept = []
    sets = {d: shingles(t) for d, t in rows}
    seen = set()
    for d, _ in sorted(rows):
        if d in seen:
            continue
        kept.append(d)
        stack = [d]
        while stack:
            x = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            for y, s in sets.items():
                both = len(sets[x] & s)
                if y not in seen and both and 100 * both >= 80 * (len(sets[x]) + len(s) - both):
                    stack.append(y)
    return kept


def table(rng):
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 120))]
        text = " ".join(w) + (f" mail u{i}@mail.org and 10.0.0.{i}" if i % 4 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}"))
        if i % 5 == 0:
            rows.append((100 + i, text.replace(" ", "\n", 1), "en", "s1"))
        if i % 7 == 0:
            w[30] = "changed"
            rows.append((200 + i, " ".join(w) + " tail", "de", None))
    rows += [(300, None, None, None), (301, "too short", "en", "s0"), (302, "again and " * 80, "en", "s0"), (5, rows[5][1], "en", "s9")]
    rows += [(None, " ".join(f"n{k}" for k in range(70)), "en", "s2"), (400, "x y z " * 30_000, "en", "s2")]
    rng.shuffle(rows)
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_stages_against_brute_force(spark):
    rows = table(random.Random(12))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "best_fit_packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS

    def good(text):
        n, _, _, _, repeats = brute_quality(text)
        return n >= 50 and 100 * repeats <= 50 * n

    passed = [r for r in rows if good(r[1])]
    assert sorted(map(str, (tuple(r) for r in out["quality_rules"]))) == sorted(map(str, passed))
    first = {}
    for r in passed:
        key = " ".join((r[1]).split())
        if key not in first or (r[0] is not None and (first[key] is None or r[0] < first[key])):
            first[key] = r[0]
    assert sorted(str(r.doc_id) for r in out["exact_dedup"]) == sorted(map(str, first.values()))
    texts = {r.doc_id: r.text for r in out["exact_dedup"]}
    expected = near_groups([(d, t) for d, t in texts.items() if d is not None])
    assert sorted(str(r.doc_id) for r in out["ngram_jaccard_join"]) == sorted([*map(str, expected), "None"])
    for r in out["pii"]:
        text, at, parts = texts[r.doc_id], 0, []
        for kind, a, b in sorted(brute_spans(text), key=lambda s: s[1:]):
            if a >= at:
                parts += [text[at:a], f"<{kind}>"]
                at = b
        assert r.text == "".join(parts) + text[at:] and r.n_chars == len(r.text)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in out["pii"]}
    assert sum(r.length for r in out["best_fit_packing"]) == sum(map(len, ids.values()))
    for r in out["best_fit_packing"]:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
