"""Loop, retrieval, delivery-contract and memory-service metrics and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import variants as v
from ..session import merged
from .detectors import finding, first_ids, grouped_finding, union_all

STAGE_KINDS = ("loop_generate", "loop_evaluate")


def loop_stages(trace: DataFrame) -> DataFrame:
    """Loop trace with the typed metadata the detectors need."""
    meta = F.parse_json("meta")
    duration = v.number(v.at(meta, "$.durationMs"))
    return trace.select(
        "session_id", "seq", "id", "kind",
        v.at(meta, "$.iteration", "bigint").alias("iteration"),
        (v.is_bool(v.at(meta, "$.ok")) & (F.to_json(v.at(meta, "$.ok")) == "false")).alias("not_ok"),
        v.string(v.at(meta, "$.failureClass")).alias("failure_class"),
        F.when(duration >= 0, duration).alias("duration_ms"),
        v.string(v.at(meta, "$.action")).alias("action"),
        v.string(v.at(meta, "$.status")).alias("status"),
    )


def _finished() -> Column:
    return F.coalesce(
        (F.col("kind") == "loop_finish") & F.col("status").isin(*fv.LOOP_FINISHED), F.lit(False)
    )


def _unclassified() -> Column:
    label = F.lower(F.trim(F.col("failure_class")))
    return F.col("kind").isin(*STAGE_KINDS) & F.col("not_ok") & (
        F.col("failure_class").isNull() | label.isin(*fv.LOOP_UNCLASSIFIED)
    )


def _timed_out() -> Column:
    return F.coalesce(F.col("kind").isin(*STAGE_KINDS) & (F.lower("failure_class") == "timeout"), F.lit(False))


def loop_incomplete(stages: DataFrame) -> DataFrame:
    """Loop traces that do not end in a recognised terminal record."""
    last = stages.groupBy("session_id").agg(
        F.max_by(F.struct("id", _finished().alias("done")), "seq").alias("last")
    )
    return finding(
        last.filter(~F.col("last.done")), 7, "loop_incomplete", "warning",
        F.lit("No recognized terminal record at the end of the selected loop trace"), F.array("last.id"),
    )


def loop_telemetry_gap(stages: DataFrame) -> DataFrame:
    """Failed stages without a failure class."""
    return grouped_finding(
        stages.filter(_unclassified()).select("session_id", "seq", "id"), 8, "loop_telemetry_gap", "warning",
        lambda n: F.format_string("Failure classification missing for %d agent stage(s)", n),
    )


def agent_timeout(stages: DataFrame) -> DataFrame:
    """Stages that timed out."""
    return grouped_finding(
        stages.filter(_timed_out()).select("session_id", "seq", "id"), 9, "agent_timeout", "warning",
        lambda n: F.format_string("Observed %d timed-out loop stage(s)", n),
    )


def stage_durations(stages: DataFrame) -> DataFrame:
    """Milliseconds per stage."""
    return (
        stages.filter(F.col("duration_ms").isNotNull())
        .groupBy("session_id", F.regexp_replace("kind", "^loop_", "").alias("stage"))
        .agg(F.sum("duration_ms").alias("duration_ms"), F.min("seq").alias("first_seq"))
    )


def loop_bottleneck(stages: DataFrame) -> DataFrame:
    """A stage that takes three quarters of at least thirty seconds."""
    per_stage = stage_durations(stages)
    # Few stage names exist, so the per-session set is tiny after the sums.
    top = per_stage.groupBy("session_id").agg(
        F.sum("duration_ms").alias("total"),
        F.min_by(F.struct("stage", "duration_ms"), F.struct(-F.col("duration_ms"), F.col("first_seq"))).alias("top"),
    ).filter((F.col("total") >= 30_000) & (F.col("top.duration_ms") / F.col("total") >= 0.75))
    hot = top.select(
        "session_id", F.concat(F.lit("loop_"), "top.stage").alias("kind"), F.col("top.stage").alias("stage"),
        F.bround(100 * F.col("top.duration_ms") / F.col("total"), 0).cast("int").alias("share"),
    )
    timed = stages.filter(F.col("duration_ms").isNotNull()).join(merged(hot.select("session_id", "kind")), ["session_id", "kind"])
    listed = hot.join(merged(first_ids(timed, ["session_id"], "seq", "id")), "session_id")
    return finding(
        listed, 10, "loop_bottleneck", "info",
        F.format_string("The %s stage consumed %d%% of recorded agent time", "stage", "share"), F.col("evidence"),
    )


def loop_findings(stages: DataFrame) -> DataFrame:
    return union_all([
        loop_incomplete(stages), loop_telemetry_gap(stages), agent_timeout(stages), loop_bottleneck(stages),
    ])


def loop_metrics(stages: DataFrame) -> DataFrame:
    """Iterations, retries, status, terminal flag, unclassified failures and total time."""
    finish = (F.col("kind") == "loop_finish") & F.col("status").isNotNull()
    return stages.groupBy("session_id").agg(
        F.max("iteration").alias("loop_iterations"),
        F.count_if((F.col("kind") == "loop_decision") & (F.col("action") == "retry")).alias("loop_retries"),
        F.max_by("status", F.when(finish, F.col("seq"))).alias("loop_status"),
        F.max_by(_finished(), "seq").alias("loop_terminal_recorded"),
        F.count_if(_unclassified()).alias("loop_failure_classification_missing"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("loop_duration_ms"),
    )


def loop_gaps(stages: DataFrame) -> DataFrame:
    """D7 and D8 together: capture problems of loop traces."""
    return loop_incomplete(stages).unionByName(loop_telemetry_gap(stages))


# --- delivery contracts -----------------------------------------------------


def contract_findings(sessions: DataFrame, trace: DataFrame) -> DataFrame:
    """Contracts that are not satisfied, with the failed events as evidence."""
    failed = sessions.filter("pipeline_success = 0").select("session_id")
    errors = trace.filter("is_error").join(merged(failed), "session_id", "left_semi")
    listed = failed.join(merged(first_ids(errors, ["session_id"], "seq", "id")), "session_id", "left")
    return finding(
        listed, 11, "pipeline_contract", "critical",
        F.lit("Declared pipeline verification contract is not satisfied"),
        F.coalesce("evidence", F.array(F.lit("result"))),
    )


def required_checks(checks: DataFrame, observed: DataFrame) -> DataFrame:
    """Required checks with their observed verdict; null where nothing was reported."""
    return checks.join(observed.select("session_id", "check", "passed"), ["session_id", "check"], "left")


def contract_totals(stages: DataFrame, checks: DataFrame) -> DataFrame:
    """Contract metrics from exploded tables: required stages and checks with observed state.

    stages: session_id, stage, status (null = missing), duration_ms.
    checks: session_id, check, passed (null = missing).
    """
    by_stage = stages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("pipeline_stages_required"),
        F.count_if(F.col("status") == "completed").alias("pipeline_stages_completed"),
        F.count_if(F.col("status").isNull()).alias("pipeline_stages_missing"),
        F.count_if(F.col("status") == "timeout").alias("pipeline_timeouts"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("pipeline_duration_ms"),
    )
    by_check = checks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("pipeline_checks_required"),
        F.count_if("passed").alias("pipeline_checks_passed"),
        F.count_if(~F.col("passed")).alias("pipeline_checks_failed"),
        F.count_if(F.col("passed").isNull()).alias("pipeline_checks_missing"),
    )
    success = (F.col("pipeline_stages_completed") == F.col("pipeline_stages_required")) & (
        F.col("pipeline_checks_passed") == F.col("pipeline_checks_required")
    )
    return by_stage.join(by_check, "session_id").withColumn("pipeline_success", success.cast("int"))


# --- retrieval --------------------------------------------------------------


def escalation_deferred(sessions: DataFrame) -> DataFrame:
    """Retrievals that still need a browser."""
    return finding(
        sessions.filter("retrieval_escalation_deferred = 1"), 12, "escalation_deferred", "warning",
        F.lit("Retrieval requires browser escalation"), F.array(F.lit("result")),
    )


# --- memory service ---------------------------------------------------------


def memory_findings(m: DataFrame) -> DataFrame:
    """Threshold rules over memory-service exports, one pass."""
    turns, pending = F.col("turn_total"), F.col("proposed_pending_total")
    percent = F.bround(100 * F.col("turn_abstain_rate"), 0).cast("int")
    rules = [
        (F.col("audit_event_count") == 0, 13, "no_gateway_traffic", "info",
         F.lit("No gatekeeper audit events in the export window"), "export"),
        ((turns >= 5) & (F.col("turn_abstain_rate") >= 0.35), 14, "high_abstain_rate", "warning",
         F.format_string("Turn abstain rate is %d%% (%d/%d)", percent, F.col("turn_abstain"), turns), "turn-abstain"),
        (pending >= 10, 15, "review_backlog", "warning",
         F.format_string("Proposed memories awaiting review: %d", pending), "review-queue"),
        ((turns >= 20) & (F.col("accepted_total") == 0), 16, "empty_memory_catalog", "critical",
         F.lit("Gateway traffic exists but no accepted memories are stored"), "store-empty"),
        ((F.col("backend") == "sqlite") & (turns >= 200), 17, "postgres_migration_candidate", "info",
         F.lit("SQLite backend with sustained turn volume"), "backend-sqlite"),
        ((F.col("backend") == "postgres") & (turns < 5) & (F.col("audit_event_count") > 0), 18,
         "postgres_overprovisioned", "info",
         F.lit("PostgreSQL backend with low observed gatekeeper traffic"), "backend-postgres"),
    ]
    fired = F.array_compact(F.array(*[
        F.when(test, F.struct(
            F.lit(order).alias("detector"), F.lit(code).alias("code"), F.lit(level).alias("severity"),
            words.alias("summary"), F.array(F.lit(proof)).alias("evidence"),
        ))
        for test, order, code, level, words, proof in rules
    ]))
    return m.select("session_id", F.inline(fired)).select(
        "session_id", "detector", F.lit(0).cast("bigint").alias("position"), "code", "severity", "summary", "evidence"
    )
