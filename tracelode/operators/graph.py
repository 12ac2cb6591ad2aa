"""Session graphs: node and edge tables, structure metrics and the iterative jobs.

Traces are mostly long single-parent chains, so the iterative jobs first shrink
the graph: every node with exactly one parent points to its nearest ancestor
that is a root or has several parents (its *anchor*), found by pointer doubling
in O(log n) joins. Depth, reachability, components and cycles are then solved
on anchors alone and read back through the pointers. All sessions advance
together; each round is cut through a shared table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import ratio
from ..names import DEFAULT, Names
from ..session import cut, discard
from .detectors import parents

S = "session_id"
MAX_ROUNDS = 200_000
#: A doubling round may make so many times its links and so many rows besides; beyond, levels are peeled.
GROWTH, SPARE_ROWS = 8, 1_000_000


def nodes(trace: DataFrame) -> DataFrame:
    """Content-free node table (G1)."""
    return trace.select(S, "id", "kind", "role", "name", "signature", "is_error")


def edges(trace: DataFrame) -> DataFrame:
    """One row per declared parent, in declared order, with its relation (G1)."""
    rows = trace.select("*", F.posexplode(parents(trace)).alias("ordinal", "src"))
    given = F.col("parent_relations")[F.col("src")] if "parent_relations" in trace.columns else F.lit(None)
    return rows.select(
        S, "src", F.col("id").alias("dst"), F.coalesce(given, F.lit(fv.DEFAULT_RELATION)).alias("relation"), "ordinal"
    )


def graph_issues(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Rows that make a graph unusable: blank or repeated ids, blank ends or relations."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    bad_nodes = node_rows.filter(blank("id")).select(S, F.lit("blank_node_id").alias("issue"), F.col("id").alias("item"))
    repeated = (
        node_rows.groupBy(S, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(S, F.lit("duplicate_node_id").alias("issue"), F.col("id").alias("item"))
    )
    bad_edges = edge_rows.filter(blank("src") | blank("dst")).select(
        S, F.lit("blank_edge_end").alias("issue"), F.coalesce("dst", "src").alias("item")
    )
    bad_relation = edge_rows.filter(blank("relation")).select(
        S, F.lit("blank_relation").alias("issue"), F.col("dst").alias("item")
    )
    return bad_nodes.unionByName(repeated).unionByName(bad_edges).unionByName(bad_relation)


def links(edge_rows: DataFrame) -> DataFrame:
    """Distinct directed links: parallel edges collapse."""
    return edge_rows.select(S, "src", "dst").distinct()


def implicit_nodes(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edge ends that no event declares."""
    ends = edge_rows.select(S, F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(node_rows.select(S, "id"), [S, "id"], "left_anti")


def roots(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Declared nodes without an incoming edge."""
    return node_rows.select(S, "id").join(edge_rows.select(S, F.col("dst").alias("id")), [S, "id"], "left_anti")


def leaves(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Declared nodes without an outgoing edge."""
    return node_rows.select(S, "id").join(edge_rows.select(S, F.col("src").alias("id")), [S, "id"], "left_anti")


def is_request(names: Names = DEFAULT) -> Column:
    """Node starts a request."""
    p = names.kind_prefix
    kind, role = F.col("kind"), F.coalesce("role", F.lit(""))
    return F.coalesce(
        kind.isin(*fv.REQUEST_KINDS, p + "payload", p + "dispatch")
        | ((kind == p + "load") & (role == "user_input"))
        | ((kind == "message") & (role == "user")),
        F.lit(False),
    )


def is_output(names: Names = DEFAULT) -> Column:
    """Node is an answer."""
    kind, role = F.col("kind"), F.coalesce("role", F.lit(""))
    return F.coalesce(
        kind.isin(*fv.OUTPUT_KINDS, names.kind_prefix + "response") | ((kind == "message") & (role == "assistant")),
        F.lit(False),
    )


def changed_artifacts(edge_rows: DataFrame) -> DataFrame:
    """Targets of created or modified edges."""
    return edge_rows.filter(F.col("relation").isin(*fv.CHANGE_RELATIONS)).select(S, F.col("dst").alias("id")).distinct()


def verified_artifacts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Changed artifacts with a verification edge to a declared node that is no error."""
    passed = node_rows.filter(~F.coalesce("is_error", F.lit(False))).select(S, F.col("id").alias("dst"))
    checks = edge_rows.filter(F.col("relation") == fv.VERIFY_RELATION).select(S, F.col("src").alias("id"), "dst")
    proven = checks.join(passed, [S, "dst"], "left_semi").select(S, "id")
    return changed_artifacts(edge_rows).join(proven, [S, "id"], "left_semi")


# --- iterative part ---------------------------------------------------------


@dataclass
class Contracted:
    """A graph with single-parent chains folded into anchors.

    pointers: session_id, id, anchor, steps, hit, open. ``open`` rows never reach an anchor: their chain is a cycle.
    merges: session_id, anchor, id, steps, hit, open: incoming links of nodes with several parents.
    """

    links: DataFrame
    pointers: DataFrame
    merges: DataFrame
    any_open: bool


def _none(df: DataFrame) -> bool:
    return df.isEmpty()


def contract(edge_rows: DataFrame, node_rows: DataFrame, names: Names = DEFAULT) -> Contracted:
    """Fold single-parent chains by pointer doubling."""
    link = cut(links(edge_rows))
    indegree = link.groupBy(S, F.col("dst").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("src").alias("parent")
    )
    starts = node_rows.filter(is_request(names)).select(S, "id", F.lit(True).alias("starts"))
    ends = link.select(S, F.explode(F.array("src", "dst")).alias("id"))
    everyone = ends.unionByName(node_rows.select(S, "id")).distinct()
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    state = cut(
        everyone.join(indegree, [S, "id"], "left").join(starts, [S, "id"], "left").select(
            S, "id",
            F.when(single, F.col("parent")).otherwise(F.col("id")).alias("anchor"),
            F.when(single, 1).otherwise(0).cast("bigint").alias("steps"),
            F.coalesce("starts", F.lit(False)).alias("hit"),
            single.alias("open"),
        )
    )
    mark = None
    for _ in range(64):
        ahead = state.select(
            S, F.col("id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"),
            F.col("hit").alias("also"),
        )
        moved = state.filter("open").join(ahead, [S, "anchor"]).select(
            S, "id", F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("hit") | F.col("also")).alias("hit"), (F.col("more") > 0).alias("open"),
        )
        before, state = state, cut(state.filter("not open").unionByName(moved))
        discard(before)
        tally = state.filter("open").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"), F.countDistinct(S, "anchor").alias("a")
        ).first()
        now = (tally["n"], tally["h"], tally["a"])
        if now[0] == 0 or now == mark:
            break
        mark = now
    else:
        raise RuntimeError("chains did not settle")
    several = indegree.filter("n > 1").select(S, F.col("id").alias("dst"))
    by_source = state.select(S, F.col("id").alias("src"), "anchor", "steps", "hit", "open")
    merges = cut(
        link.join(several, [S, "dst"]).join(by_source, [S, "src"])
        .groupBy(S, "anchor", F.col("dst").alias("id"), "open")
        .agg(F.max(F.col("steps") + 1).alias("steps"), F.bool_or("hit").alias("hit"))
    )
    return Contracted(link, state, merges, now[0] > 0)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _best(tables: list[DataFrame]) -> DataFrame:
    """The greatest depth so far of each id, from the rows that the rounds have appended."""
    return _all(tables).groupBy(S, "id").agg(F.max("depth").alias("depth"))


def _products(walks: DataFrame) -> int:
    """Rows that joining the walks with themselves gives."""
    ends = walks.groupBy(S, "id").agg(F.count(F.lit(1)).alias("n"))
    starts = walks.groupBy(S, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    return ends.join(starts, [S, "id"]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0


def _doubled_depths(walks: DataFrame, spare_rows: int) -> tuple[list[DataFrame], DataFrame | None] | None:
    """Longest walks to each id by (max,+) doubling, and the ids that arbitrarily long walks reach.

    Round k has the best walk of 2^k links between each pair of anchors that has one. It lengthens the best walks of
    fewer links, and joined with itself gives the next round's walks. Where no cycle is, walks end after as many
    doublings as the depth has bits. Walks of more links than there are anchors have met a cycle. None if a round would
    make more rows than the links and ``spare_rows`` allow: hubs, whose pairs are many, are better peeled level by level.
    """
    links = walks.count()
    anchors = walks.select(S, "id").distinct().count()
    tables: list[DataFrame] = []
    length = 1
    while links:
        ahead = walks
        if tables:
            known = _best(tables).select(S, F.col("id").alias("src"), "depth")
            ahead = walks.join(known, [S, "src"], "left")
        else:
            ahead = walks.withColumn("depth", F.lit(None).cast("bigint"))
        longer = ahead.groupBy(S, "id").agg(F.max(F.coalesce("depth", F.lit(0)) + F.col("steps")).alias("depth"))
        if tables:
            old = _best(tables).withColumnRenamed("depth", "old")
            longer = longer.join(old, [S, "id"], "left").filter("old is null or depth > old").drop("old")
        tables.append(cut(longer))
        if length > anchors:
            return tables, cut(walks.select(S, "id").distinct())
        if _products(walks) > GROWTH * links + spare_rows:
            discard(walks, *tables)
            return None
        after = walks.select(S, F.col("src").alias("id"), F.col("id").alias("end"), F.col("steps").alias("more"))
        before, walks = walks, cut(walks.join(after, [S, "id"]).groupBy(S, "src", F.col("end").alias("id")).agg(F.max(F.col("steps") + F.col("more")).alias("steps")))
        discard(before)
        if _none(walks):
            break
        length *= 2
    return tables, None


def _peeled_depths(merges: DataFrame, roots: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Depths level by level: each round settles the ids whose links all come from settled anchors."""
    tables, pending = [roots], merges
    for _ in range(MAX_ROUNDS):
        if _none(pending):
            break
        known = _all(tables).select(S, F.col("id").alias("anchor"), F.col("depth").alias("at"))
        tried = pending.join(known, [S, "anchor"], "left").groupBy(S, "id").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("open"), F.col("at"))).alias("ready"),
            F.max(F.col("at") + F.col("steps")).alias("depth"),
        )
        fresh = cut(tried.filter("n = ready").select(S, "id", "depth"))
        if _none(fresh):
            break
        tables.append(fresh)
        before, pending = pending, cut(pending.join(fresh, [S, "id"], "left_anti"))
        if before is not merges:
            discard(before)
    else:
        raise RuntimeError("depths did not settle")
    return tables, pending


def _anchor_depths(g: Contracted, spare_rows: int = SPARE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Longest-path depth of every resolvable anchor, and the merge links that stay unresolved."""
    roots = (
        g.pointers.filter("steps = 0").select(S, "id")
        .join(g.merges.select(S, "id"), [S, "id"], "left_anti")
        .withColumn("depth", F.lit(0).cast("bigint"))
    )
    # What hangs on a ring of single parents is never settled: as if it were its own parent.
    src = F.when(F.col("open"), F.col("id")).otherwise(F.col("anchor"))
    walks = cut(g.merges.groupBy(S, src.alias("src"), "id").agg(F.max("steps").alias("steps")))
    doubled = _doubled_depths(walks, spare_rows)
    if doubled is None:
        tables, pending = _peeled_depths(g.merges, cut(roots))
        return _all(tables), pending
    tables, endless = doubled
    if not tables:
        return roots, g.merges.limit(0)
    solved = _best(tables)
    if endless is None:
        return roots.unionByName(solved), g.merges.limit(0)
    return roots.unionByName(solved.join(endless, [S, "id"], "left_anti")), cut(g.merges.join(endless, [S, "id"], "left_semi"))


def depths(g: Contracted) -> DataFrame:
    """Depth per node; null for nodes on or behind a cycle."""
    solved, _ = _anchor_depths(g)
    base = solved.select(S, F.col("id").alias("anchor"), "depth")
    return g.pointers.join(base, [S, "anchor"], "left").select(
        S, "id", F.when(~F.col("open"), F.col("depth") + F.col("steps")).alias("depth")
    )


def graph_depth(g: Contracted) -> DataFrame:
    """Per session: whether the graph is acyclic, and its longest path when it is."""
    per_node = depths(g)
    acyclic = F.count(F.lit(1)) == F.count("depth")
    return per_node.groupBy(S).agg(
        acyclic.alias("is_dag"), F.when(acyclic, F.max("depth")).alias("max_depth")
    )


def shortcuts(hops: DataFrame) -> DataFrame:
    """Hops (session, src, id) and, from each src, jumps of 2, 4, 8 ... hops along one hop of each (pointer jumping).

    A jump leads where hops lead, so what is reachable stays the same, but a path of n such hops takes log n rounds.
    """
    jump = first = cut(hops.groupBy(S, "src").agg(F.min("id").alias("id")))
    tables, span, most = [hops.select(S, "src", "id")], 1, jump.count()
    while span < most:
        ahead = jump.select(S, F.col("src").alias("id"), F.col("id").alias("next"))
        jump = cut(jump.join(ahead, [S, "id"]).select(S, "src", F.col("next").alias("id")))
        if _none(jump):
            break
        tables.append(jump)
        span *= 2
    out = cut(_all(tables).distinct())
    discard(first, jump, *tables[1:])
    return out


def _spread(start: DataFrame, hops: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    """All (session, id) reachable from ``start`` over hops (session, src, id), frontier by frontier; rows are appended."""
    hops = shortcuts(hops) if jumps is None else jumps
    own = [hops] if jumps is None else []
    frontier = cut(start.select(S, "id").distinct())
    seen = [frontier]
    for _ in range(MAX_ROUNDS):
        step = hops.join(frontier.withColumnRenamed("id", "src"), [S, "src"]).select(S, "id").distinct()
        frontier = cut(step.join(_all(seen), [S, "id"], "left_anti"))
        if _none(frontier):
            discard(*own, frontier)
            return _all(seen)
        seen.append(frontier)
        if len(seen) > 16:
            seen = [cut(_all(seen))]
    raise RuntimeError("reachability did not settle")


def reachable(g: Contracted) -> DataFrame:
    """Nodes that are a request or lie behind one."""
    hit_anchor = g.merges.filter("hit").select(S, "id")
    hops = g.merges.select(S, F.col("anchor").alias("src"), "id")
    own = g.pointers.filter("hit").select(S, "id")
    if _none(g.merges):
        return own
    starts = g.pointers.filter("hit and steps = 0").select(S, "id").unionByName(hit_anchor)
    reached = _spread(starts, hops)
    through = g.pointers.join(reached.withColumnRenamed("id", "anchor"), [S, "anchor"], "left_semi").select(S, "id")
    return own.unionByName(through).distinct()


def reachable_outputs(node_rows: DataFrame, g: Contracted, names: Names = DEFAULT) -> DataFrame:
    """Outputs behind a request."""
    return node_rows.filter(is_output(names)).select(S, "id").join(reachable(g), [S, "id"], "left_semi")


def components(g: Contracted) -> DataFrame:
    """Weakly connected component per node, named by its smallest member.

    Anchors are labelled by minimum over neighbours plus one pointer jump per
    round; chain members take the label of their anchor.
    """
    direct = g.merges.select(S, F.col("anchor").alias("a"), F.col("id").alias("b"))
    if g.any_open:
        loose = g.pointers.filter("open").select(S, F.col("id").alias("dst"))
        raw = g.links.join(loose, [S, "dst"], "left_semi").select(S, F.col("src").alias("a"), F.col("dst").alias("b"))
        direct = direct.unionByName(raw)
        direct = cut(direct)
    # Read from the stored links in each round: a table of both directions would be twice as large as they are.
    both = direct.unionByName(direct.select(S, F.col("b").alias("a"), F.col("a").alias("b")))
    label = held = cut(
        both.groupBy(S, F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    )
    for _ in range(MAX_ROUNDS):
        if _none(direct):
            break
        offered = both.join(label.select(S, F.col("id").alias("b"), "label"), [S, "b"]).groupBy(
            S, F.col("a").alias("id")
        ).agg(F.min("label").alias("offer"))
        lowered = label.join(offered, [S, "id"]).select(
            S, "id", F.least("label", "offer").alias("label"), F.col("label").alias("old")
        )
        lowered = cut(lowered)
        discard(held)
        target = lowered.select(S, F.col("id").alias("label"), F.col("label").alias("jump"))
        jumped = cut(lowered.join(target, [S, "label"]).select(
            S, "id", F.least("label", "jump").alias("label"), "old"
        ))
        discard(lowered)
        label, held = jumped.select(S, "id", "label"), jumped
        if _none(jumped.filter(F.col("label") != F.col("old"))):
            break
    else:
        raise RuntimeError("components did not settle")
    named = label.withColumnRenamed("id", "anchor")
    placed = g.pointers.withColumn("anchor", F.when(F.col("open"), F.col("id")).otherwise(F.col("anchor")))
    member = placed.join(named, [S, "anchor"], "left").select(S, "id", F.coalesce("label", "anchor").alias("label"))
    # The anchor label names the group; the smallest member names the component.
    lowest = member.groupBy(S, "label").agg(F.min("id").alias("component"))
    return member.join(lowest, [S, "label"]).select(S, "id", "component")


def cycle_nodes(g: Contracted) -> DataFrame:
    """Nodes on a directed cycle, self-loops included."""
    # Pure single-parent cycles: after enough doubling the pointers land on cycle nodes only.
    ring = g.pointers.filter("open").select(S, F.col("anchor").alias("id")).distinct()
    _, pending = _anchor_depths(g)
    stuck = cut(pending.select(S, "id").distinct())
    hops = cut(
        pending.select(S, F.col("anchor").alias("src"), "id")
        .join(stuck.withColumnRenamed("id", "src"), [S, "src"], "left_semi").distinct()
    )
    if _none(hops):
        return ring
    groups = cut(_strong_groups(stuck, hops))
    src = groups.select(S, F.col("id").alias("src"), F.col("scc").alias("scc_a"))
    inner = cut(
        hops.join(src, [S, "src"]).join(groups, [S, "id"]).filter("scc = scc_a").select(S, "src", "id")
    )
    # Walk each cyclic hop back along its chain to the anchor.
    heads = g.pointers.select(S, F.col("id").alias("tail"), "anchor", "steps")
    tails = (
        g.links.select(S, F.col("src").alias("tail"), F.col("dst").alias("id"))
        .join(heads, [S, "tail"]).join(inner.withColumnRenamed("src", "anchor"), [S, "anchor", "id"], "left_semi")
        .filter("steps > 0").select(S, F.col("tail").alias("id"))
    )
    chain = g.pointers.filter("steps > 0").select(S, "id")
    upward = g.links.join(chain.withColumnRenamed("id", "dst"), [S, "dst"], "left_semi").join(
        chain.withColumnRenamed("id", "src"), [S, "src"], "left_semi"
    ).select(S, F.col("dst").alias("src"), F.col("src").alias("id"))
    walked = _spread(tails, upward)
    ends = inner.select(S, F.explode(F.array("src", "id")).alias("id"))
    return ring.unionByName(walked).unionByName(ends).distinct()


def _trimmed(alive: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with hops in and out, and the hops between them; the others are on no cycle. Two rounds of it."""
    for _ in range(2):
        alive = alive.join(hops.select(S, "id").distinct(), [S, "id"], "left_semi").join(
            hops.select(S, F.col("src").alias("id")).distinct(), [S, "id"], "left_semi")
        alive = cut(alive)
        hops = cut(hops.join(alive, [S, "id"], "left_semi").join(alive.withColumnRenamed("id", "src"), [S, "src"], "left_semi"))
    return alive, hops


def _coloured(alive: DataFrame, jumps: DataFrame) -> DataFrame:
    """Each id with the greatest id that reaches it; colours travel over hops and jumps."""
    colour = cut(alive.withColumn("colour", F.col("id")))
    for _ in range(MAX_ROUNDS):
        offered = jumps.join(colour.select(S, F.col("id").alias("src"), "colour"), [S, "src"]).groupBy(S, "id").agg(
            F.max("colour").alias("offer")
        )
        new = cut(colour.join(offered, [S, "id"], "left").select(
            S, "id", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), F.col("colour").alias("old")
        ))
        colour = new.select(S, "id", "colour")
        if _none(new.filter("colour <> old")):
            return colour
    raise RuntimeError("colours did not settle")


def _strong_groups(alive: DataFrame, hops: DataFrame) -> DataFrame:
    """Strongly connected groups (session, id, scc); ids on no cycle may be left out.

    In each round every colour's pivot, the greatest id, is searched backward from inside its colour: what it reaches
    so is its group. Forward and backward search jump along pointers, so a long ring takes log rounds.
    """
    found = [alive.select(S, "id", F.col("id").alias("scc")).limit(0)]
    alive, hops = _trimmed(alive, hops)
    for _ in range(MAX_ROUNDS):
        if _none(alive):
            return _all(found)
        jumps = shortcuts(hops)
        colour = _coloured(alive, jumps)
        a = colour.select(S, F.col("id").alias("src"), F.col("colour").alias("colour_a"))
        # A jump inside one colour passes through ids of that colour only, so it may be gone backward too.
        inside = lambda rows: rows.join(a, [S, "src"]).join(colour, [S, "id"]).filter("colour = colour_a").select(
            S, F.col("id").alias("src"), F.col("src").alias("id"))
        back = shortcuts(cut(inside(hops)))
        within = cut(back.unionByName(inside(jumps)).distinct())
        members = _spread(colour.filter("id = colour").select(S, "id"), within, within)
        group = cut(members.join(colour, [S, "id"]).select(S, "id", F.col("colour").alias("scc")))
        found.append(group)
        alive = alive.join(group, [S, "id"], "left_anti")
        left = hops.join(alive, [S, "id"], "left_semi").join(alive.withColumnRenamed("id", "src"), [S, "src"], "left_semi")
        alive, hops = _trimmed(cut(alive), cut(left))
    raise RuntimeError("strong groups did not settle")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(S).agg(F.count(F.lit(1)).alias(name))


def graph_metrics(trace: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """All structure metrics of every session."""
    node_rows, edge_rows = cut(nodes(trace)), cut(edges(trace))
    g = contract(edge_rows, node_rows, names)
    shape = cut(graph_depth(g))
    cyclic = not _none(shape.filter("not is_dag"))
    rings = cycle_nodes(g) if cyclic else node_rows.limit(0)
    base = node_rows.groupBy(S).agg(
        F.count(F.lit(1)).alias("declared_nodes"),
        F.count_if(is_request(names)).alias("request_roots"),
        F.count_if(is_output(names)).alias("outputs"),
    )
    counted = [
        _count(implicit_nodes(node_rows, edge_rows), "implicit_nodes"),
        _count(edge_rows, "edges"),
        _count(roots(node_rows, edge_rows), "roots"),
        _count(leaves(node_rows, edge_rows), "leaves"),
        components(g).groupBy(S).agg(F.countDistinct("component").alias("weakly_connected_components")),
        _count(rings, "cycle_nodes"),
        _count(reachable_outputs(node_rows, g, names), "reachable_outputs"),
        _count(changed_artifacts(edge_rows), "changed_artifacts"),
        _count(verified_artifacts(node_rows, edge_rows), "verified_artifacts"),
    ]
    out = base.join(shape, S, "left")
    for part in counted:
        out = out.join(part, S, "left")
    out = out.fillna(0, [part.columns[-1] for part in counted])
    return out.withColumn("request_output_coverage", ratio(F.col("reachable_outputs"), F.col("outputs"))).withColumn(
        "artifact_verification_coverage", ratio(F.col("verified_artifacts"), F.col("changed_artifacts"))
    )
