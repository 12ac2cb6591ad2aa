"""Graphs that are deep, cyclic or full of hubs: results and numbers of rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import graph


def contracted(spark, pairs):
    e = spark.createDataFrame([("s", a, b, "precedes") for a, b in pairs], "session_id string, src string, dst string, relation string")
    n = e.select("session_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns(
        {"kind": F.lit("k"), "role": F.lit(None).cast("string")})
    return graph.contract(e, n)


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that graph jobs write."""
    count, cut = [0], graph.cut

    def counted(df):
        count[0] += 1
        return cut(df)

    monkeypatch.setattr(graph, "cut", counted)
    return count


def brute_depths(pairs):
    """Longest path to each node; None on or behind a cycle."""
    parents, ids = {}, sorted({x for p in pairs for x in p})
    for a, b in pairs:
        parents.setdefault(b, set()).add(a)
    depth, todo = {}, set(ids)
    while ready := [i for i in todo if all(p in depth for p in parents.get(i, ()))]:
        for i in ready:
            depth[i] = max((depth[p] + 1 for p in parents.get(i, ())), default=0)
        todo -= set(ready)
    return {i: depth.get(i) for i in ids}


def brute_cycles(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found = set()
    for start in after:
        seen, todo = set(), [start]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if start in seen:
            found.add(start)
    return found


def depths_of(g):
    return {r["id"]: r["depth"] for r in graph.depths(g).collect()}


def test_ladder_of_ten_thousand_merges(spark, rounds):
    levels = 10_000
    name = lambda side, i: f"{side}{i:05d}"
    pairs = [(name(x, i), name(y, i + 1)) for i in range(levels) for x in "ab" for y in "ab"]
    g = contracted(spark, pairs)
    rounds[0] = 0
    found = depths_of(g)
    # Two tables a round, walks and depths.
    assert rounds[0] < 2 * 20
    assert found == {name(x, i): i for i in range(levels + 1) for x in "ab"}


@pytest.mark.parametrize("spare", [10**6, -10**6])
def test_depths_and_cycles_of_random_graphs(spark, monkeypatch, spare):
    """Four graphs as one: their ids differ. With and without room for doubling."""
    monkeypatch.setattr(graph._anchor_depths, "__defaults__", (spare,))
    draw, pairs = random.Random(11), set()
    for k, (size, links, back) in enumerate(((12, 20, 0), (30, 45, 1), (30, 60, 4), (8, 30, 8))):
        ids = [f"g{k}n{i:02d}" for i in range(size)]
        pairs |= {tuple(sorted(draw.sample(ids, 2))) for _ in range(links)} | {tuple(sorted(draw.sample(ids, 2), reverse=True)) for _ in range(back)}
    pairs.add(("g3n00", "g3n00"))
    g = contracted(spark, sorted(pairs))
    assert depths_of(g) == brute_depths(pairs)
    assert {r["id"] for r in graph.cycle_nodes(g).collect()} == brute_cycles(pairs)


def test_long_ring_with_chords(spark, rounds):
    size = 1500
    ids = [f"r{i:04d}" for i in range(size)]
    pairs = [(ids[i], ids[(i + 1) % size]) for i in range(size)] + [(ids[i], ids[(i + 3) % size]) for i in range(0, size, 2)]
    pairs += [(ids[7], "out1"), ("out1", "out2"), ("in1", ids[9])]
    g = contracted(spark, pairs)
    rounds[0] = 0
    assert {r["id"] for r in graph.cycle_nodes(g).collect()} == set(ids)
    assert rounds[0] < 150


def test_hub_is_peeled(spark, rounds):
    pairs = [(f"a{i}", "hub") for i in range(300)] + [("hub", f"b{i}") for i in range(300)] + [(f"c{i}", f"b{i}") for i in range(300)]
    g = contracted(spark, pairs)
    solved, pending = graph._anchor_depths(g, 0)
    found = {r["id"]: r["depth"] for r in solved.collect()}
    assert pending.isEmpty() and found["hub"] == 1 and found["b7"] == 2 and found["c7"] == 0


def test_jumps_reach_what_hops_reach(spark):
    hops = spark.createDataFrame([("s", f"{i:03d}", f"{i + 1:03d}") for i in range(300)] + [("s", "900", "901")], "session_id string, src string, id string")
    start = spark.createDataFrame([("s", "100")], "session_id string, id string")
    assert {r["id"] for r in graph._spread(start, hops).collect()} == {f"{i:03d}" for i in range(100, 301)}
