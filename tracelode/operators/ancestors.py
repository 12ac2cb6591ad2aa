"""How many nodes lie behind a request, without a row for each request and ancestor.

Every node hangs under the earliest later node that names it. These links form trees, whatever the edges are, since
each leads to a later node. A tree is numbered so that all behind a node is one interval: subtree sizes and offsets
come by pointer doubling, in rounds logarithmic in the depth. A request is then a few intervals, one for each
outermost match. Links beside the trees, also those that close a cycle, are exceptions: where one ends inside an
interval of a request, the interval of its start joins. Intervals are nested or disjoint, so the outermost ones
sum to the count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import Running, by_count, running

MAX_ROUNDS = 10_000


def _none(df: DataFrame) -> bool:
    return df.isEmpty()


def tree_links(links: DataFrame, places: DataFrame) -> DataFrame:
    """id and the node it hangs under, p: of the later nodes that name it, the first in (seq, id) order.

    links: id, up; places: id, seq.
    """
    at = places.select("id", F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), "id").alias("at"))
    met = links.join(at, "id").join(at.select(F.col("id").alias("up"), F.col("at").alias("of")), "up")
    return met.filter(F.col("at") < F.col("of")).groupBy("id").agg(F.min("of").alias("of")).select("id", F.col("of.id").alias("p"))


def _sizes(state: DataFrame) -> DataFrame:
    """Adds size, the nodes of each subtree, to id and p: every round the pointers and the depth counted double."""
    jump = cut(state.select("id", F.col("p").alias("q"), F.lit(1).cast("bigint").alias("size")))
    for _ in range(MAX_ROUNDS):
        live = jump.filter(F.col("q").isNotNull())
        if _none(live):
            return state.join(jump.select("id", "size"), "id")
        more = live.groupBy(F.col("q").alias("id")).agg(F.sum("size").alias("more"))
        hops = live.select(F.col("id").alias("q"), F.col("q").alias("next"))
        moved = live.join(hops, "q", "left").select("id", F.col("next").alias("q"), "size")
        every = moved.unionByName(jump.filter(F.col("q").isNull()))
        jump = cut(every.join(more, "id", "left").select("id", "q", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    raise RuntimeError("subtree sizes did not settle")


def _numbers(state: DataFrame) -> DataFrame:
    """id, root, lo and hi: the number of each node in its tree, and the last number behind it."""
    order = ["id"]
    kids, segment = by_count(cut(state.filter(F.col("p").isNotNull())), ["p"], order)
    offsets = running(kids, ["p"], order, [Running("before", "sum", F.col("size"), include_current=False)], segment)
    placed = offsets.select("id", "p", "size", (F.col("before") + 1).cast("bigint").alias("lo"))
    tops = state.filter(F.col("p").isNull()).select("id", "p", "size", F.lit(0).cast("bigint").alias("lo"))
    done = [cut(tops.select("id", F.col("id").alias("root"), "lo", "size"))]
    # Each round the nodes whose pointer reached a top leave; the others jump twice as far.
    live = cut(placed)
    for _ in range(MAX_ROUNDS):
        if _none(live):
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out.select("id", "root", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))
        ahead = live.select(F.col("id").alias("p"), F.col("p").alias("next"), F.col("lo").alias("add"))
        moved = cut(live.join(ahead, "p", "left").select(
            "id", F.coalesce("next", "p").alias("p"), "size", (F.col("lo") + F.coalesce("add", F.lit(0))).alias("lo"),
            F.col("next").isNull().alias("settled")))
        # A pointer without a live node behind it names one that settled before: its number is final.
        settled = moved.filter("settled").drop("settled")
        known = done[0]
        for part in done[1:]:
            known = known.unionByName(part)
        ends = known.select(F.col("id").alias("p"), "root", F.col("lo").alias("add"))
        done.append(cut(settled.join(ends, "p").select("id", "root", (F.col("lo") + F.col("add")).alias("lo"), "size")))
        live = moved.filter("not settled").drop("settled")
    raise RuntimeError("numbers did not settle")


def intervals(links: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals of all nodes (id, root, lo, hi), and the exceptions among the links (root, lo, hi, to_root, to_lo).

    A link that starts inside the interval of its end says nothing new and is no exception.
    """
    tree = cut(tree_links(links, places))
    ends = links.select(F.explode(F.array("id", "up")).alias("id")).unionByName(places.select("id")).distinct()
    state = cut(_sizes(cut(ends.join(tree, "id", "left"))))
    spans = cut(_numbers(state))
    to = spans.select(F.col("id").alias("up"), F.col("root").alias("to_root"), F.col("lo").alias("to_lo"), F.col("hi").alias("to_hi"))
    beside = links.join(tree.withColumnRenamed("p", "up"), ["id", "up"], "left_anti").join(spans, "id").join(to, "up")
    inside = (F.col("root") == F.col("to_root")) & F.col("lo").between(F.col("to_lo"), F.col("to_hi"))
    return spans, cut(beside.filter(~inside).select("root", "lo", "hi", "to_root", "to_lo").distinct())


def outermost(held: DataFrame) -> DataFrame:
    """Of the intervals (request, root, lo, hi) of a request those inside no other."""
    keys, order = ["request", "root"], ["lo"]
    rows, segment = by_count(cut(held.distinct()), keys, order)
    reach = running(rows, keys, order, [Running("reach", "max", F.col("hi"), include_current=False)], segment)
    return reach.filter(F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).select("request", "root", "lo", "hi")


def behind(matches: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """request and ancestors: the distinct nodes that are matched or lie behind a match.

    matches: request, id; links: id, up (id lies behind up); places: id, seq of all nodes, unique by id.
    """
    spans, exceptions = intervals(links, places)
    seen = frontier = cut(outermost(matches.join(spans, "id").select("request", "root", "lo", "hi")))
    if not _none(exceptions):
        start = exceptions.select(*[F.col(c).alias("x_" + c) for c in ("root", "lo", "hi")], "to_root", "to_lo")
        for _ in range(MAX_ROUNDS):
            meets = (F.col("root") == F.col("to_root")) & F.col("to_lo").between(F.col("lo"), F.col("hi"))
            step = frontier.join(start, meets).select("request", *[F.col("x_" + c).alias(c) for c in ("root", "lo", "hi")]).distinct()
            frontier = cut(step.join(seen.select("request", "root", "lo"), ["request", "root", "lo"], "left_anti"))
            if _none(frontier):
                break
            seen = cut(seen.unionByName(frontier))
        else:
            raise RuntimeError("ancestors did not settle")
        seen = outermost(seen)
    return seen.groupBy("request").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("ancestors"))
