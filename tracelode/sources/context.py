"""Context-event captures: scan, validation, queries and the derived event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import DEFAULT, Names
from ..operators.metrics import duplicate_ids
from ..operators.ordered import layered_digest
from ..schemas import CONTEXT_EVENTS, CONTEXT_LOG, snake
from ..session import cut

REQUIRED = (
    "event_id", "session_id", "agent_id", "producer_seq", "wall_time", "observation", "evidence", "adapter_id",
    "boundary", "coverage",
)
ID_LISTS = ("parent_event_ids", "lineage_event_ids")
COUNTERS = ("usage_input_tokens", "usage_output_tokens", "usage_cached_tokens")
#: Columns of the derived table with a Bloom filter for each row group.
KEY_COLUMNS = ("event_id", "request_id", "source_key", "content_version_key")
QUERY_FIELDS = ("session_id", "request_id", "source_key", "content_version_key", "adapter_id", "observation")


def no_ids() -> Column:
    return F.array().cast("array<string>")


def from_log(raw: DataFrame) -> DataFrame:
    """Camel-case log rows to context events; missing id lists become empty."""
    rows = raw.select(*[F.col(f.name).alias(snake(f.name)) for f in CONTEXT_LOG])
    return rows.withColumns({c: F.coalesce(c, no_ids()) for c in ID_LISTS})


def to_log(events: DataFrame) -> DataFrame:
    """Context events back to the log's field names."""
    return events.select(*[F.col(snake(f.name)).alias(f.name) for f in CONTEXT_LOG])


def problem(names: Names = DEFAULT) -> Column:
    """Why a context event is unusable; null when it is fine."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED])
    bad = reduce(
        lambda a, b: a | b,
        [F.coalesce((F.col(c) < 0) | F.isnan(c) | (F.col(c) == float("inf")), F.lit(False)) for c in COUNTERS],
    )
    return (
        F.when(~F.col("schema_version").eqNullSafe(names.context_schema), "wrong_schema")
        .when(missing, "missing_field").when(bad, "bad_usage_counter")
    )


def valid(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    return events.filter(problem(names).isNull())


def rejected(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    return events.withColumn("reason", problem(names)).filter(F.col("reason").isNotNull())


def scan(spark: SparkSession, path: str, names: Names = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Valid events and rejects (row, reason) of a JSONL capture, from one pass over its text.

    A line that is no object, or has a value of a wrong type, is a malformed row; blank lines are passed over.
    """
    damaged = "_damaged"
    schema = T.StructType([*CONTEXT_LOG.fields, T.StructField(damaged, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": damaged}).alias("r")).select("value", "r.*")
    events = from_log(parsed)
    kept = parsed.select(
        F.struct(*[F.coalesce(F.col(f.name), no_ids()).alias(snake(f.name)) if snake(f.name) in ID_LISTS else F.col(f.name).alias(snake(f.name))
                   for f in CONTEXT_LOG]).alias("event"), "value", damaged)
    judged = kept.select("event.*", F.col("value").alias("_row"), F.col(damaged).isNotNull().alias("_bad"))
    reason = F.when(F.col("_bad"), "malformed_row").otherwise(problem(names))
    stored = cut(judged.withColumn("_reason", reason).drop("_bad"))
    return (
        stored.filter(F.col("_reason").isNull()).select(*events.columns),
        stored.filter(F.col("_reason").isNotNull()).select(F.col("_row").alias("row"), F.col("_reason").alias("reason")),
    )


def own_events(events: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """Only rows with the expected schema tag."""
    return events.filter(F.col("schema_version") == names.context_schema)


def query(events: DataFrame, limit: int | None = None, **equals: str | None) -> DataFrame:
    """Events matching every given field, by producer sequence."""
    unknown = set(equals) - set(QUERY_FIELDS)
    if unknown:
        raise ValueError(f"unknown query fields: {sorted(unknown)}")
    kept = reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]) if kv[1] else df, equals.items(), events)
    ordered = kept.orderBy("producer_seq")
    return ordered if limit is None else ordered.limit(limit)


def write_index(events: DataFrame, path: str, buckets: int = 256, files_per_bucket: int = 8) -> int:
    """Full rebuild of the derived event table; fails on a repeated event id.

    Rows of one bucket are spread over several writers, so a huge session does
    not end in one task. Files are sorted by session and sequence, and have Bloom
    filters of the key columns, sized by the keys that a row group has.
    """
    repeated = duplicate_ids(events, "event_id")
    if not repeated.isEmpty():
        raise ValueError("duplicate event ids: the table cannot be built")
    placed = events.withColumn("session_bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    spread = placed.repartition("session_bucket", F.pmod(F.xxhash64("event_id"), F.lit(files_per_bucket)))
    writer = spread.sortWithinPartitions("session_bucket", "session_id", "producer_seq").write.mode("overwrite")
    writer = writer.partitionBy("session_bucket").option("parquet.bloom.filter.adaptive.enabled", "true")
    for key in KEY_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)
    return events.sparkSession.read.parquet(path).count()


def read_index(spark: SparkSession, path: str, session_id: str | None = None, buckets: int = 256) -> DataFrame:
    """The derived table; a session filter prunes to one bucket."""
    table = spark.read.parquet(path)
    if session_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(session_id)), F.lit(buckets))
        table = table.filter((F.col("session_bucket") == bucket) & (F.col("session_id") == session_id))
    return table.drop("session_bucket")


def lookup(spark: SparkSession, path: str, key: str, value: str, session_id: str | None = None, buckets: int = 256) -> DataFrame:
    """Rows of the derived table with one value of a key column.

    Row groups whose Bloom filter or dictionary lacks the value are passed over unread; a session, where known,
    leaves one bucket of files.
    """
    if key not in KEY_COLUMNS:
        raise ValueError(f"no lookup by {key}; keys are {KEY_COLUMNS}")
    return read_index(spark, path, session_id, buckets).filter(F.col(key) == value)


def event_count(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


def index_digest(events: DataFrame) -> DataFrame:
    """Order-stable digest of (event id, sequence, content version) per session."""
    line = F.to_json(
        F.struct("event_id", "producer_seq", "content_version_key"), {"ignoreNullFields": "false"}
    )
    return layered_digest(events, ["session_id"], "producer_seq", line)


def build(df: DataFrame, columns: dict[str, Column], names: Names = DEFAULT) -> DataFrame:
    """A context-event row per input row; fields not given are null, id lists empty."""
    given = {
        "schema_version": F.lit(names.context_schema), "agent_id": F.lit("agent-main"),
        "parent_event_ids": no_ids(), "lineage_event_ids": no_ids(), **columns,
    }
    if "event_id" not in given:
        given["event_id"] = F.substring(
            F.sha2(F.concat_ws("/", given["session_id"], given["producer_seq"].cast("string")), 256), 1, 32
        )
    return df.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTEXT_EVENTS
    ])
