"""Append-log tailing, late rows and per-turn state on Structured Streaming.

Rows of a turn arrive in any order and in any micro-batch. A stateful processor therefore holds them, sets an event
timer at the turn's latest row, and works when the watermark has passed it: on the rows in the recorder's order, with
what it carries from earlier rows of the turn. So what is emitted doesn't depend on how rows fell into batches.
Rows that come behind the watermark are not lost either: ``split_late`` deals every row into one of two tables.
How late a row may be, and how long a silent turn is remembered, is the caller's choice; nothing is assumed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as fv
from ..names import DEFAULT, Names
from ..schemas import CONTEXT_LOG
from ..sources import context

KEY = ["session_id", "request_id"]
#: Observation and boundary of the row by which a recorder closes its log: it only moves the watermark on.
CLOSED = ("capture_health", "log.closed")


def read_log(spark: SparkSession, folder: str, names: Names = DEFAULT, files_per_batch: int = 1000) -> DataFrame:
    """Valid context events of a growing folder of JSONL logs."""
    raw = spark.readStream.schema(CONTEXT_LOG).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return context.valid(context.from_log(raw), names)


def append(events: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per checkpoint."""
    writer = events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def event_time():
    """Event time from the recorder's clock; null where it can't be read."""
    return F.try_to_timestamp("wall_time")


def with_time(events: DataFrame, lateness: str) -> DataFrame:
    """Event time, with the watermark that bounds all state: rows later than ``lateness`` are behind it."""
    return events.withColumn("event_time", event_time()).withWatermark("event_time", lateness)


def without_repeats(events: DataFrame, lateness: str) -> DataFrame:
    """Drop repeated event ids while the watermark bounds the remembered ids."""
    return with_time(events, lateness).dropDuplicatesWithinWatermark(["event_id"])


def is_closing():
    """The row that closes a log."""
    return F.coalesce((F.col("observation") == CLOSED[0]) & (F.col("boundary") == CLOSED[1]), F.lit(False))


# --- late rows --------------------------------------------------------------


def split_late(
    events: DataFrame, on_time: str, late: str, marks: str, checkpoint: str, lateness: str, available_now: bool = False
) -> StreamingQuery:
    """Deal every row of a stream into one of two tables, by batch.

    A row is late if its event time lies more than ``lateness`` behind the newest row of the earlier batches, or if it
    has none. Each batch writes its own folders, ``batch=<id>``, and its newest time to ``marks``, and reads the marks
    of the batches before it only; a batch that runs again after a failure overwrites its folders with the same rows.
    A stream read from ``on_time`` with the same ``lateness`` drops nothing.
    """

    def deal(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("event_time", event_time()).persist()
        known = spark.read.schema("newest timestamp, batch bigint").option("basePath", marks)
        earlier = known.parquet(marks).where(F.col("batch") < batch) if batch else None
        newest = earlier.agg(F.max("newest")).first()[0] if batch else None
        # One value, the newest time so far.
        bound = F.lit(newest or datetime(1, 1, 1)) - F.expr(f"interval {lateness}")
        in_time = F.coalesce(F.col("event_time") >= bound, F.lit(False))
        reason = F.when(F.col("event_time").isNull(), "no_event_time").otherwise("behind_watermark")
        rows.where(in_time).write.mode("overwrite").parquet(os.path.join(on_time, f"batch={batch}"))
        rows.where(~in_time).withColumn("reason", reason).write.mode("overwrite").parquet(os.path.join(late, f"batch={batch}"))
        rows.agg(F.max("event_time").alias("newest")).write.mode("overwrite").parquet(os.path.join(marks, f"batch={batch}"))
        rows.unpersist()

    writer = events.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- state of turns -----------------------------------------------------------


class HeldRows(StatefulProcessor):
    """Hold a key's rows until the watermark has passed the latest, then work on them in the recorder's order.

    Subclasses say what they hold (``HELD``, with ``seq`` and ``event_id``), what they carry on (``CARRY``, one row of
    state), and how held rows and the carry become results (``release``). Memory is the rows of a turn that the
    watermark has not passed, and the carry until the turn has been silent for ``idle_ms`` of event time.
    """

    KEYS: tuple[str, ...] = tuple(KEY)
    HELD: str
    CARRY: str
    START: tuple

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.HELD)
        self.carry = handle.getValueState("carry", self.CARRY)
        self.latest = handle.getValueState("latest", "ms bigint")
        self.columns = [part.split()[0] for part in self.HELD.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.latest.get()[0] if self.latest.exists() else 0
        for part in rows:
            part = part[part["held"]]
            if len(part):
                # A row without a time counts as of the watermark.
                times = part["event_time"].dropna()
                newest = max(newest, int(times.max().timestamp() * 1000) if len(times) else max(1, timerValues.getCurrentWatermarkInMs()))
                self.held.appendList([tuple(row) for row in part[self.columns].to_numpy(object).tolist()])
        if newest:
            self.latest.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            # Silent since its last release.
            self.carry.clear()
            self.latest.clear()
            return
        rows = pd.DataFrame(list(self.held.get()), columns=self.columns).sort_values(["seq", "event_id"], kind="stable", ignore_index=True)
        carry = self.carry.get() if self.carry.exists() else self.START
        found, carry = self.release(rows, tuple(carry))
        self.held.clear()
        self.carry.update(carry)
        self.handle.registerTimer(self.latest.get()[0] + self.idle_ms)
        if len(found):
            yield found.assign(**dict(zip(self.KEYS, key, strict=True)))

    def release(self, rows: pd.DataFrame, carry: tuple) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: HeldRows, schema: str) -> DataFrame:
    """``rows`` (keys, event_time, held, and what the processor holds) through its state."""
    # Rows of all keys share Arrow batches, where one null makes a column of whole numbers a column of floats.
    numbers = [name for name, kind in (part.split() for part in processor.HELD.split(", ")) if kind == "bigint"]
    rows = rows.withColumns({c: F.when(F.col("held"), F.col(c)).otherwise(0) for c in numbers})
    return rows.groupBy(*processor.KEYS).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class TurnGaps(HeldRows):
    """Answers before which the turn has no payload, and no tool event either."""

    HELD = "seq bigint, event_id string, kind string"
    CARRY = "payloads bigint, tools bigint"
    START = (0, 0)
    #: Boundaries of the two gap rows.
    PAYLOAD, TOOLS = "capture_health.missing_provider_payload", "capture_health.missing_tool_events"

    def release(self, rows, carry):
        payloads = carry[0] + (rows["kind"] == "payload").cumsum()
        tools = carry[1] + (rows["kind"] == "tool").cumsum()
        bare = (rows["kind"] == "answer") & (payloads == 0)
        found = [rows.loc[bare, ["seq", "event_id"]].assign(boundary=self.PAYLOAD), rows.loc[bare & (tools == 0), ["seq", "event_id"]].assign(boundary=self.TOOLS)]
        return pd.concat(found), (int(payloads.iloc[-1]), int(tools.iloc[-1]))


_GAP = "session_id string, request_id string, seq bigint, event_id string, boundary string"


def is_tool_event():
    return F.coalesce(
        (F.col("source_category") == "tool_result") & (F.col("boundary").isin("tool_call.start", "tool_result")), F.lit(False)
    )


def turn_gaps(events: DataFrame, lateness: str, idle_ms: int) -> DataFrame:
    """End-of-turn gap rows as a stream, whatever batches the turn's rows fall into."""
    kind = (
        F.when(F.col("observation").isin("payload", "dispatch"), "payload").when(is_tool_event(), "tool")
        .when(F.col("observation") == "response", "answer")
    )
    marked = with_time(events, lateness).withColumn("kind", kind)
    marked = marked.withColumn("held", F.col("kind").isNotNull() & F.col("request_id").isNotNull()).filter(F.col("held") | is_closing())
    rows = marked.select(*KEY, F.col("producer_seq").alias("seq"), "event_id", "kind", "event_time", "held")
    return _stateful(rows, TurnGaps(idle_ms), _GAP)


def turn_gaps_batch(events: DataFrame) -> DataFrame:
    """Batch twin of ``turn_gaps``: compare each answer with the first payload and tool event of its turn."""
    seq = F.col("producer_seq")
    firsts = events.filter(F.col("request_id").isNotNull()).groupBy("session_id", "request_id").agg(
        F.min(F.when(F.col("observation").isin("payload", "dispatch"), seq)).alias("first_payload"),
        F.min(F.when(is_tool_event(), seq)).alias("first_tool"),
    )
    answers = events.filter((F.col("observation") == "response") & F.col("request_id").isNotNull()).select(
        "session_id", "request_id", seq.alias("seq"), "event_id"
    ).join(firsts, ["session_id", "request_id"])
    no_payload = F.coalesce(F.col("first_payload") > F.col("seq"), F.lit(True))
    no_tool = F.coalesce(F.col("first_tool") > F.col("seq"), F.lit(True))
    rows = F.array_compact(F.array(
        F.when(no_payload, F.lit("capture_health.missing_provider_payload")),
        F.when(no_payload & no_tool, F.lit("capture_health.missing_tool_events")),
    ))
    return answers.select("session_id", "request_id", "seq", "event_id", F.explode(rows).alias("boundary"))


class RecentSources(HeldRows):
    """The last eight sources before each payload of a turn, numbered along the turn."""

    HELD = "seq bigint, event_id string, is_source boolean"
    CARRY = "pushed bigint, ids array<string>"
    START = (0, [])

    def release(self, rows, carry):
        pushed, kept = carry[0], list(carry[1] or [])
        is_source = rows["is_source"].to_numpy(bool)
        ids = np.array(kept + rows.loc[is_source, "event_id"].tolist(), object)
        first = pushed - len(kept) + 1
        # Sources before each payload, as places in ids: the last eight of them.
        before = len(kept) + np.cumsum(is_source)[~is_source]
        size = np.minimum(before, fv.RECENT_SOURCES)
        place = np.repeat(before - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found = pd.DataFrame({
            "payload_id": np.repeat(rows.loc[~is_source, "event_id"].to_numpy(object), size), "source_id": ids[place], "source_no": first + place})
        return found, (pushed + int(is_source.sum()), ids[-fv.RECENT_SOURCES:].tolist())


_RECENT = "session_id string, request_id string, payload_id string, source_id string, source_no bigint"


def recent_sources(marks: DataFrame, idle_ms: int) -> DataFrame:
    """Recent-source buffer as a stream: (session_id, request_id, producer_seq, event_id, event_time, is_source) in (T4).

    ``event_time`` carries the watermark of ``with_time``; ``is_source`` is null in a row that only moves it on.
    """
    rows = marks.select(*KEY, F.col("producer_seq").alias("seq"), "event_id", "is_source", "event_time", F.col("is_source").isNotNull().alias("held"))
    return _stateful(rows, RecentSources(idle_ms), _RECENT)


class CumulativeDrops(HeldRows):
    """The running number of dropped rows."""

    KEYS = ("session_id",)
    HELD = "seq bigint, event_id string, dropped bigint"
    CARRY = "total bigint"
    START = (0,)

    def release(self, rows, carry):
        found = rows.assign(cumulative=carry[0] + rows["dropped"].cumsum())
        return found, (int(found["cumulative"].iloc[-1]),)


_DROPS = "session_id string, seq bigint, event_id string, dropped bigint, cumulative bigint"


def cumulative_drops(drops: DataFrame, idle_ms: int) -> DataFrame:
    """Running drop count per session as a stream: (session_id, producer_seq, event_id, dropped, event_time) in (T5).

    ``event_time`` carries the watermark; ``dropped`` is null in a row that only moves it on. A session that stays
    silent for ``idle_ms`` starts again at zero.
    """
    rows = drops.select("session_id", F.col("producer_seq").alias("seq"), "event_id", "dropped", "event_time", F.col("dropped").isNotNull().alias("held"))
    return _stateful(rows, CumulativeDrops(idle_ms), _DROPS)
