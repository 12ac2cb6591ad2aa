"""What a job has used up must not stay on disk."""

import os

from pyspark.sql import functions as F

from tracelode.catalog import queries
from tracelode.operators import graph
from tracelode.session import FREE, cut, discard, shared_dir


def _cuts(spark):
    top = shared_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(top) if name.startswith("cut-")} if os.path.isdir(top) else set()


def _chain(spark, n):
    """One chain of n nodes, and a node with two parents at its end."""
    links = [("s", f"{i:04}", f"{i + 1:04}") for i in range(n)] + [("s", "x", f"{n:04}")]
    edges = spark.createDataFrame(links, "session_id string, src string, dst string").withColumn("relation", F.lit("next"))
    ids = sorted({x for _, a, b in links for x in (a, b)})
    nodes = spark.createDataFrame([("s", i) for i in ids], "session_id string, id string").withColumns(
        {"kind": F.lit("step"), "role": F.lit(None).cast("string"), "is_error": F.lit(False)})
    return nodes, edges, ids


def test_cut_frees_what_it_has_shuffled(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    before, setting = files(), spark.conf.get(FREE, "false")
    table = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and files() <= before + 2
    assert spark.conf.get(FREE, "false") == setting


def test_discard_leaves_other_frames_alone(spark):
    table = cut(spark.range(3))
    derived = table.filter("id > 0")
    discard(derived)
    assert derived.count() == 2
    made = _cuts(spark)
    discard(table)
    assert len(made - _cuts(spark)) == 1


def test_rounds_keep_only_their_last_tables(spark):
    nodes, edges, ids = _chain(spark, 40)
    made = _cuts(spark)
    g = graph.contract(edges, nodes)
    assert len(_cuts(spark) - made) == 3  # links, pointers, merges
    found = graph.components(g)
    assert len(_cuts(spark) - made) == 4
    assert {(r.id, r.component) for r in found.collect()} == {(i, ids[0]) for i in ids}
    assert graph.graph_depth(g).first().max_depth == 40


def test_queries_read_nothing_that_was_discarded(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, "F"), (2, 1, "P"), (3, 2, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7, 1, 1, "N"), (2, 7, 1, 1, "R"), (3, 8, 1, 1, "N")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.session_id: (r.outputs, r.reachable) for r in queries.request_outputs(spark, str(tmp_path)).collect()}
    assert got == {"n0": (2, 1), "n1": (1, 1)}
    parts = {(r.session_id, r.component) for r in queries.components(spark, str(tmp_path)).collect()}
    assert parts == {("n0", "c1"), ("n0", "r2"), ("n1", "c2")}
    assert {(r.session_id, r.is_dag, r.max_depth) for r in queries.lineage_depth(spark, str(tmp_path)).collect()} == {("n0", True, 2), ("n1", True, 2)}
