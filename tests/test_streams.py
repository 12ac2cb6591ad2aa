"""Streams whose rows arrive out of order, late or twice, against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tracelode.catalog import queries
from tracelode.catalog import standin as st
from tracelode.session import work_path
from tracelode.sources import context
from tracelode.streaming import tail

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shuffled_log(spark):
    """A log of three files: odd rows, then even rows, so that each turn is torn and out of order, then the closing row."""
    events = st.context(spark, SF)
    folder = work_path(spark, "log")
    for odd in (1, 0):
        context.to_log(events.filter(F.col("producer_seq") % 2 == odd)).coalesce(1).write.mode("append").json(folder)
    context.to_log(queries._closing(events)).coalesce(1).write.mode("append").json(folder)
    return events, folder


def drained(spark, stream):
    return sorted(map(tuple, queries._drained(spark, stream).collect()))


def test_gaps_do_not_depend_on_batches(spark, shuffled_log):
    events, folder = shuffled_log
    stream = tail.turn_gaps(tail.read_log(spark, folder, files_per_batch=1), "1 hour", 1000)
    assert drained(spark, stream) == sorted(map(tuple, tail.turn_gaps_batch(events).collect()))


def test_recent_sources_do_not_depend_on_batches(spark, shuffled_log):
    events, folder = shuffled_log

    def stream(files):
        log = tail.with_time(tail.read_log(spark, folder, files_per_batch=files), "1 hour")
        kind = F.when(~tail.is_closing(), F.col("observation") == "load")
        wanted = F.col("observation").isin("load", "payload", "dispatch") | tail.is_closing()
        return tail.recent_sources(log.filter(wanted).withColumn("is_source", kind), 1000)

    torn = drained(spark, stream(1))
    assert torn == drained(spark, stream(10)) and torn
    seqs = {r["event_id"]: r["producer_seq"] for r in events.select("event_id", "producer_seq").collect()}
    assert all(seqs[source] < seqs[payload] for _, _, payload, source, _ in torn)


def test_drops_are_summed_in_the_recorders_order(spark, shuffled_log):
    events, folder = shuffled_log
    log = tail.with_time(tail.read_log(spark, folder, files_per_batch=1), "1 hour")
    drops = log.withColumn("dropped", F.when(~tail.is_closing(), F.col("producer_seq") % 3))
    found = drained(spark, tail.cumulative_drops(drops, 1000))
    total = {}
    for session, seq in sorted((r["session_id"], r["producer_seq"]) for r in events.collect()):
        total[session] = total.get(session, 0) + seq % 3
        total[session, seq] = total[session]
    assert {(s, seq): c for s, seq, _, _, c in found} == {k: v for k, v in total.items() if isinstance(k, tuple)}


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_drops_share_a_batch_with_the_closing_row(spark, partitions):
    """All sessions and the closing row, whose numbers are null, in one file and so in one Arrow batch of a partition."""
    first = 2**53 + 1
    rows = [(s, first + i, f"{s}-{i}", i + 1, "2026-01-01T00:00:00Z") for s in ("a", "b", "closing-too", "x", "y", "z") for i in range(3)]
    rows.append(("closing", None, "closing", None, "2026-02-01T00:00:00Z"))
    schema = "session_id string, producer_seq bigint, event_id string, dropped bigint, wall_time string"
    folder = work_path(spark, "log")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        log = tail.with_time(spark.readStream.schema(schema).json(folder), "1 hour")
        found = drained(spark, tail.cumulative_drops(log, 1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == sorted((s, seq, e, n, n * (n + 1) // 2) for s, seq, e, n, _ in rows[:-1])



def test_every_row_is_on_time_or_late(spark, shuffled_log):
    events, _ = shuffled_log
    folder = work_path(spark, "log")
    middle = events.agg(F.max("producer_seq")).first()[0] // 2
    untimed = events.limit(3).withColumns({"event_id": F.concat(F.lit("no-time-"), "event_id"), "wall_time": F.lit("soon")})
    for part in (events.filter(F.col("producer_seq") > middle), events.filter(F.col("producer_seq") <= middle).unionByName(untimed)):
        context.to_log(part).coalesce(1).write.mode("append").json(folder)
    tables = [work_path(spark, name) for name in ("ontime", "late", "marks")]

    def run():
        stream = tail.read_log(spark, folder, files_per_batch=1)
        tail.split_late(stream, *tables, work_path(spark, "state"), "3 seconds", available_now=True).awaitTermination()
        return tuple(sorted(r[0] for r in spark.read.parquet(table).select("event_id").collect()) for table in tables[:2])

    on_time, late = run()
    assert sorted([*on_time, *late]) == sorted(r[0] for r in events.unionByName(untimed).select("event_id").collect())
    assert late and not set(on_time) & set(late)
    reasons = {r["reason"] for r in spark.read.parquet(tables[1]).collect()}
    assert reasons == {"behind_watermark", "no_event_time"}
    # The same batches again, as after a lost checkpoint, write the same rows over.
    assert run() == (on_time, late)


def test_lateness_has_no_default():
    with pytest.raises(TypeError):
        tail.turn_gaps(None)
