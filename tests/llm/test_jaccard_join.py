import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, clash, docs, given

from tracelode.llm import components, jaccard_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def varied(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("block", [2, 256])
def test_groups_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 1000 if block == 2 else 1 << 20)
    rng = random.Random(9)
    common = [f"line{i}" for i in range(12)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([5, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            w = varied(rng, base, rng.randrange(0, max(1, len(base) // 20) + 1))
            rows.append(" ".join(w + (common if rng.random() < 0.5 else [])))
        # A chain of small steps, whose ends are far apart.
        for _ in range(6):
            base = varied(rng, base, max(1, len(base) // 60))
            rows.append(" ".join(base).upper())
    texts = AWKWARD + rows + rows[:5]
    ids = [3 * i for i in range(len(texts) - 1)] + [None]
    pairs = list(zip(ids, texts, strict=True))
    rng.shuffle(pairs)
    got = jaccard_join.groups(clash(docs(spark, [t for _, t in pairs], [d for d, _ in pairs]))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(pairs)


def test_groups_on_given_rows(spark):
    rows = [(r.doc_id, r.text) for r in given(spark).collect()]
    got = jaccard_join.groups(given(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert jaccard_join.groups(docs(spark, [])).collect() == []


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(200)]
    sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
    tree = jaccard_join.Trie(sets, sizes)
    for i in range(60):
        both = [len(np.intersect1d(sets[i], s)) for s in sets]
        expected = {j for j, o in enumerate(both) if 100 * o >= 60 * (sizes[i] + sizes[j] - o)}
        assert set(tree.probe(sets[i], sizes[i], 60).tolist()) == expected


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = components.components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}
