"""Session files to JSON lines, with every rejected line or file kept as an error row.

A ``lines`` table has: source, line_no (1-based), ordinal (0-based among
non-blank lines) and line. Any table of raw log lines can take the place of
files from here on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import variants as v
from ..names import DEFAULT, Names
from ..operators.ordered import Running, running
from ..session import cut


def scan_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Lines and errors of every session file below ``root``.

    Files are read as text splits, so one of any size is read by many tasks. A line's number follows from the
    count of lines in the splits before its own. Files of blank lines only are errors; Spark's readers pass over
    files of no bytes.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    listed = spark.read.format("binaryFile").options(**options).load(root).select(F.col("path").alias("source"))
    text = spark.read.options(**options, lineSep="\n").text(root)
    raw = cut(text.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    ))
    kept = ~F.col("line").rlike(r"^\s*$")
    numbered = running(
        raw, ["source"], ["block", "place"],
        [Running("line_no", "count"), Running("usable", "sum", kept.cast("long"))], F.col("block"),
    )
    broken = raw.filter(~F.is_valid_utf8("line")).select("source").distinct()
    lines = numbered.filter(kept).join(broken, "source", "left_anti").select(
        "source", "line_no", (F.col("usable") - 1).alias("ordinal"), "line")
    null_line = F.lit(None).cast("bigint").alias("line_no")
    empty = listed.join(raw.filter(kept).select("source").distinct(), "source", "left_anti")
    return lines, broken.select("source", null_line, F.lit("invalid_utf8").alias("reason")).unionByName(
        empty.select("source", null_line, F.lit("empty_session").alias("reason")))


def split_lines(bodies: DataFrame) -> DataFrame:
    """Non-blank lines of whole-file texts (source, body), in file order."""
    numbered = F.transform(
        F.split("body", "\n"), lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line"))
    )
    kept = F.filter(numbered, lambda r: ~r["line"].rlike(r"^\s*$"))
    return bodies.select("source", F.posexplode(kept).alias("ordinal", "r")).select(
        "source", "r.line_no", F.col("ordinal").cast("bigint").alias("ordinal"), "r.line"
    )


def parse(lines: DataFrame) -> DataFrame:
    """Lines with the parsed ``value`` and, where a line is unusable, the ``reason``."""
    value = F.try_parse_json("line")
    reason = (
        F.when(F.col("value").isNull(), "invalid_json")
        .when(~v.is_object(F.col("value")), "not_an_object")
    )
    return lines.withColumn("value", value).withColumn("reason", reason).drop("line")


def detect_format(value: Column, names: Names = DEFAULT) -> Column:
    """Format of a session from its first object (S3)."""
    has = lambda key: F.array_contains(F.json_object_keys(F.to_json(value)), key)
    return (
        F.when(
            F.coalesce(v.string(v.at(value, "$.event")).isin(*fv.LOOP_EVENTS), F.lit(False)) & has("iteration"),
            names.loop_format,
        )
        .when(F.coalesce(v.string(v.at(value, "$.type")) == "session", F.lit(False)) & has("version"), names.pi_format)
        .otherwise(names.generic_format)
    )


def with_format(parsed: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """Every line with its session's format and the id its header gives; of a header no more goes to each line."""
    ident = v.at(F.col("value"), "$.id")
    head = parsed.filter(F.col("reason").isNull() & (F.col("ordinal") == 0)).select(
        "source", detect_format(F.col("value"), names).alias("format"),
        F.when(v.truthy(ident), v.text(ident)).alias("header_id"),
    )
    return parsed.join(head, "source", "left")


def stem(source: Column) -> Column:
    """File name without its last extension."""
    name = F.element_at(F.split(source, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def folder(source: Column) -> Column:
    """Name of the folder a file lies in; empty when there is none."""
    return F.coalesce(F.element_at(F.filter(F.split(source, "/"), lambda p: p != ""), -2), F.lit(""))
