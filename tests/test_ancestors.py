"""Ancestor counts by intervals against a closure in plain Python."""

import random

import pytest

from tracelode.operators import ancestors, ordered


@pytest.fixture
def tables(monkeypatch):
    """Counts the tables that are written."""
    count, cut = [0], ancestors.cut

    def counted(df):
        count[0] += 1
        return cut(df)

    monkeypatch.setattr(ancestors, "cut", counted)
    return count


def brute(matches, links):
    parents, out = {}, {}
    for i, up in links:
        parents.setdefault(up, set()).add(i)
    for request, i in matches:
        seen, todo = out.setdefault(request, set()), [i]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += parents.get(at, ())
    return {request: len(seen) for request, seen in out.items()}


def found(spark, matches, links, places):
    rows = ancestors.behind(
        spark.createDataFrame(matches, "request string, id string"), spark.createDataFrame(links, "id string, up string"),
        spark.createDataFrame(places, "id string, seq bigint"))
    return {r["request"]: r["ancestors"] for r in rows.collect()}


@pytest.mark.parametrize("seed, rows", [(1, None), (2, 3)])
def test_links_of_any_shape(spark, monkeypatch, seed, rows):
    """Several summaries of one event, cycles, loops, links back in time, ties and unplaced nodes."""
    if rows:
        monkeypatch.setattr(ordered, "SEGMENT_ROWS", rows)
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(40)]
    links = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)} | {("n1", "n1"), ("n2", "n3"), ("n3", "n2")})
    places = [(i, None if i == "n5" else rng.randrange(12)) for i in ids]
    matches = sorted({(f"q{rng.randrange(6)}", rng.choice(ids)) for _ in range(12)})
    assert found(spark, matches, links, places) == brute(matches, links)


def test_long_chains_of_summaries(spark, tables):
    """Each summary covers three events and the summary before it; the last one names all summaries again."""
    n = 600
    links = [(f"e{k}-{j}", f"s{k}") for k in range(n) for j in range(3)] + [(f"s{k}", f"s{k + 1}") for k in range(n - 1)]
    links += [(f"s{k}", f"s{n - 1}") for k in range(0, n - 2, 50)]
    places = [(f"s{k}", 10 * k + 9) for k in range(n)] + [(f"e{k}-{j}", 10 * k + j) for k in range(n) for j in range(3)]
    matches = [("all", f"s{n - 1}"), ("all", "e7-1"), ("some", "s99"), ("some", "e300-0"), ("one", "e5-2")]
    assert found(spark, matches, links, places) == {"all": 4 * n, "some": 401, "one": 1}
    assert tables[0] < 45


def test_nothing_matched_or_linked(spark):
    assert found(spark, [], [("a", "b")], [("a", 1), ("b", 2)]) == {}
    assert found(spark, [("q", "a")], [], [("a", 1)]) == {"q": 1}
