"""Sinks for context exports (S28); analysis tables are written by ``plans.analysis.write_analysis``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import DEFAULT, Names
from ..operators import seam
from ..operators.metrics import duplicate_ids


def write_generic_jsonl(events: DataFrame, path: str, names: Names = DEFAULT) -> DataFrame:
    """Write the generic export as JSON lines; returns row counts per session."""
    if not duplicate_ids(events, "event_id").isEmpty():
        raise ValueError("duplicate event ids prevent an unambiguous export")
    export = seam.generic_rows(events, names)
    export.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
