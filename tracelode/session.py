"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    # Stateful processors need lists, timers and state that outgrows the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Removes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What the queries run inside have shuffled is freed when each ends."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; where that is unset, a folder of the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_work")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for an intermediate table."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that has rows for each session: never broadcast on an estimate.

    Spark takes the size of compressed files for that of their rows, so millions of them pass for a few MB and are
    gathered on the driver.
    """
    return side.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job through a table in the shared folder.

    The rows survive the loss of executors, and columnar files keep each later
    round's scan pruned to the columns it needs. What the writing has shuffled is freed.
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    with freeing(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
