"""The four semantic views over canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _count_where(condition: Column, name: str) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).alias(name)


def _distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def tool_calls(events: DataFrame) -> DataFrame:
    """Calls with their first result, then results without a call.

    The first result of a (run, call id) by time and id answers every call with that id; the others are
    not shown. A result without an id, or with an empty one, answers nothing. One exchange by the pair
    serves the ranking and the joins.
    """
    who = ["run_id", "session_id", "conversation_id", "turn_id", "adapter_name", "source_kind", "tool_name", "tool_call_id"]
    key = ["run_id", "tool_call_id"]
    calls = events.filter("record_format = 'tool_call'").select(*who, F.col("event_id").alias("call_event_id"), F.col("timestamp_unix_ms").alias("call_timestamp_unix_ms"))
    results = events.filter("record_format = 'tool_result'").select(*who, F.col("event_id").alias("result_event_id"), F.col("timestamp_unix_ms").alias("result_timestamp_unix_ms"))
    first = Window.partitionBy(*key).orderBy("result_timestamp_unix_ms", "result_event_id")
    answers = (
        results.filter("tool_call_id <> ''")
        .withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .select(*key, F.col("tool_name").alias("answer_tool"), "result_event_id", "result_timestamp_unix_ms")
    )
    gap = F.col("result_timestamp_unix_ms") - F.col("call_timestamp_unix_ms")
    paired = F.coalesce(gap >= 0, F.lit(False))
    status = F.when(gap.isNull(), "missing_result").when(gap < 0, "invalid_order").otherwise("paired")
    answered = calls.join(answers, key, "left").select(
        *who[:6],
        F.coalesce("tool_name", "answer_tool").alias("tool_name"),
        "tool_call_id",
        "call_event_id",
        "result_event_id",
        "call_timestamp_unix_ms",
        "result_timestamp_unix_ms",
        F.when(paired, gap).alias("duration_ms"),
        F.when(paired, F.lit("paired")).alias("duration_source"),
        F.when(paired, F.lit("medium")).alias("duration_quality"),
        status.alias("pairing_status"),
    )
    orphans = results.join(calls.select(*key), key, "left_anti").select(
        *who,
        F.lit(None).cast("string").alias("call_event_id"),
        "result_event_id",
        F.lit(None).cast("long").alias("call_timestamp_unix_ms"),
        "result_timestamp_unix_ms",
        F.lit(None).cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("duration_source"),
        F.lit(None).cast("string").alias("duration_quality"),
        F.lit("orphan_result").alias("pairing_status"),
    )
    return answered.unionByName(orphans)


def sessions(events: DataFrame) -> DataFrame:
    """A row for each run and named session: span, counts by kind, distinct ids."""
    ms = F.col("timestamp_unix_ms")
    return (
        events.filter("session_id <> ''")
        .groupBy("run_id", "session_id")
        .agg(
            F.min(ms).alias("first_event_timestamp_unix_ms"),
            F.max(ms).alias("last_event_timestamp_unix_ms"),
            (F.max(ms) - F.min(ms)).alias("duration_ms"),
            F.count("*").alias("event_count"),
            *(_count_where(F.col("record_format") == kind, f"{kind}_count") for kind in ("tool_call", "tool_result")),
            *(_count_where(F.col("event_type") == kind, f"{kind}_count") for kind in ("prompt", "response", "error")),
            *(_distinct(c, f"distinct_{n}_count") for c, n in (("conversation_id", "conversation"), ("turn_id", "turn"), ("tool_name", "tool"), ("adapter_name", "adapter"))),
        )
    )


def adapters(events: DataFrame) -> DataFrame:
    """A row for each adapter; an empty session id counts as one."""
    ms = F.col("timestamp_unix_ms")
    return events.groupBy("adapter_name").agg(
        F.count("*").alias("event_count"),
        _distinct("run_id", "run_count"),
        _distinct("session_id", "session_count"),
        F.min(ms).alias("first_event_timestamp_unix_ms"),
        F.max(ms).alias("last_event_timestamp_unix_ms"),
        *(_count_where(F.col("event_type") == kind, f"{kind}_count") for kind in ("prompt", "response")),
        *(_count_where(F.col("record_format") == kind, f"{kind}_count") for kind in ("tool_call", "tool_result")),
        _count_where(F.col("event_type") == "error", "error_event_count"),
        _count_where(F.col("warnings_json") != "[]", "warning_record_count"),
        _count_where(F.col("errors_json") != "[]", "error_record_count"),
        _count_where(F.col("pii_redacted") == 1, "pii_redacted_count"),
    )


def quality(events: DataFrame) -> DataFrame:
    """A row for each adapter and timestamp quality."""
    return events.groupBy("adapter_name", "timestamp_quality").agg(
        F.count("*").alias("event_count"),
        *(_count_where(F.col(f"{c}_json") != "[]", n) for c, n in (("warnings", "warning_record_count"), ("errors", "error_record_count"), ("flags", "flagged_record_count"))),
        _count_where(F.col("pii_redacted") == 1, "pii_redacted_count"),
    )


VIEWS = {"v_tool_calls": tool_calls, "v_sessions": sessions, "v_adapters": adapters, "v_quality": quality}


def register(spark: SparkSession, events: DataFrame, runs: DataFrame, watermarks: DataFrame) -> dict[str, DataFrame]:
    """Register the mart's tables and views for SQL; gives them by name."""
    found = {"agentlog_events": events, "ingest_runs": runs, "ingest_watermarks": watermarks}
    found |= {name: view(events) for name, view in VIEWS.items()}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found
