"""The sixteen questions of the answerability benchmark, as DataFrame plans.

A plan takes the mart's relations by name. Look-back windows end at the latest time in the data and
include their first instant; an empty mart has no latest time and nothing to look back on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.timeparse import day_bucket, hour_bucket, rfc3339_seconds

Relations = dict[str, DataFrame]
DAY_MS = 86_400_000
SLOW_MS = 2_000
TOP = 50
RECENT_RUNS = 30


def _since(df: DataFrame, stamp: str, source: DataFrame, latest: str, span_ms: int) -> DataFrame:
    """Rows of `df` within `span_ms` of the latest time of `source`; the bound is one row, broadcast."""
    bound = source.agg(F.max(latest).alias("__latest"))
    return df.crossJoin(F.broadcast(bound)).filter(F.col("__latest").isNull() | (F.col(stamp) >= F.col("__latest") - span_ms)).drop("__latest")


def _named(column: str = "tool_name") -> Column:
    return F.coalesce(column, F.lit("unknown")).alias("tool_name")


def _paired(r: Relations) -> DataFrame:
    return r["v_tool_calls"].filter("pairing_status = 'paired' AND duration_ms IS NOT NULL")


def nearest_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Exact nearest-rank percentiles of each group: name -> (a, b, c) takes the value at rank (a * n + b) div c.

    Rows are counted by value before anything is ordered, with partial sums, so a group that holds most
    rows brings its distinct values to a task and not its rows.
    """
    group = Window.partitionBy(*keys)
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__k"))
    placed = counted.withColumn("__upto", F.sum("__k").over(group.orderBy(value))).withColumn("__n", F.sum("__k").over(group))
    at = lambda a, b, c: F.expr(f"({a} * __n + {b}) div {c}")
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") >= at(*rank), F.col(value))).alias(name) for name, rank in ranks.items()))


def _share(part: Column, whole: Column) -> Column:
    """Percent to two places; nothing of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") * 100.0 / F.nullif(whole, F.lit(0)).cast("double"), 2))


def calls_per_tool(r: Relations) -> DataFrame:
    calls = _since(r["v_tool_calls"].filter("call_event_id IS NOT NULL"), "call_timestamp_unix_ms", r["agentlog_events"], "timestamp_unix_ms", 7 * DAY_MS)
    return calls.groupBy(_named()).agg(F.count("*").alias("invocation_count")).orderBy(F.desc("invocation_count"), "tool_name").limit(TOP)


def sessions_per_day(r: Relations) -> DataFrame:
    events = r["agentlog_events"]
    recent = _since(events.filter("session_id <> ''").select("timestamp_unix_ms", "session_id"), "timestamp_unix_ms", events, "timestamp_unix_ms", 14 * DAY_MS)
    return recent.groupBy(day_bucket(F.col("timestamp_unix_ms")).alias("day_utc")).agg(F.count_distinct("session_id").alias("unique_sessions")).orderBy("day_utc")


def events_per_adapter(r: Relations) -> DataFrame:
    counts = r["agentlog_events"].groupBy("adapter_name").agg(F.count("*").alias("event_count"))
    total = counts.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("__total"))
    share = _share(F.col("event_count"), F.col("__total")).alias("event_share_pct")
    return counts.crossJoin(F.broadcast(total)).select("adapter_name", "event_count", share).orderBy(F.desc("event_count"), "adapter_name")


def calls_per_conversation(r: Relations) -> DataFrame:
    calls = r["v_tool_calls"].filter("call_event_id IS NOT NULL AND conversation_id <> ''")
    return calls.groupBy("conversation_id").agg(F.count("*").alias("tool_call_count")).orderBy(F.desc("tool_call_count"), "conversation_id").limit(TOP)


def latency_per_tool(r: Relations) -> DataFrame:
    recent = _since(_paired(r), "call_timestamp_unix_ms", r["v_tool_calls"], "call_timestamp_unix_ms", DAY_MS)
    return nearest_rank(recent.select(_named(), "duration_ms"), ["tool_name"], "duration_ms", {"p50_duration_ms": (1, 1, 2), "p95_duration_ms": (95, 99, 100)}).orderBy("tool_name")


def duration_per_session(r: Relations) -> DataFrame:
    named = _paired(r).filter("session_id <> ''")
    return named.groupBy("session_id").agg(F.sum("duration_ms").alias("total_tool_duration_ms")).orderBy(F.desc("total_tool_duration_ms"), "session_id").limit(TOP)


def slow_share_per_adapter(r: Relations) -> DataFrame:
    share = _share(F.count_if(F.col("duration_ms") > SLOW_MS), F.count("*"))
    return _paired(r).groupBy("adapter_name").agg(share.alias("slow_call_pct")).orderBy(F.desc("slow_call_pct"), "adapter_name")


def hourly_latency_of_top_tools(r: Relations) -> DataFrame:
    paired = _paired(r).select(_named(), "duration_ms", hour_bucket(F.col("call_timestamp_unix_ms")).alias("hour_utc"))
    top = paired.groupBy("tool_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_name").limit(3).select("tool_name")
    chosen = paired.join(F.broadcast(top), "tool_name", "left_semi")
    return nearest_rank(chosen, ["hour_utc", "tool_name"], "duration_ms", {"median_duration_ms": (1, 1, 2)}).orderBy("hour_utc", "tool_name")


def refresh_per_source(r: Relations) -> DataFrame:
    return r["ingest_watermarks"].groupBy("source_kind").agg(F.max("refreshed_at_utc").alias("last_successful_refresh_at_utc")).orderBy("source_kind")


def stale_sources(r: Relations) -> DataFrame:
    marks = r["ingest_watermarks"].withColumn("__s", rfc3339_seconds(F.col("refreshed_at_utc")))
    newest = marks.agg(F.max("__s").alias("__newest"))
    age = F.coalesce((F.col("__newest") - F.coalesce("__s", "__newest")) * 1000, F.lit(0).cast("long"))
    return marks.filter("staleness_state = 'stale'").crossJoin(F.broadcast(newest)).select("source_key", "staleness_state", age.alias("staleness_age_ms")).orderBy(F.desc("staleness_age_ms"), "source_key")


def refresh_success_share(r: Relations) -> DataFrame:
    recent = r["ingest_runs"].orderBy(F.desc("started_at_utc"), F.desc("ingest_run_id")).limit(RECENT_RUNS)
    return recent.agg(_share(F.count_if(F.col("status") == "success"), F.count("*")).alias("refresh_success_rate_pct"))


def last_events_written(r: Relations) -> DataFrame:
    done = r["ingest_runs"].filter("status = 'success'")
    return done.agg(F.coalesce(F.max_by("events_written", F.struct("started_at_utc", "ingest_run_id")), F.lit(0).cast("long")).alias("events_written"))


def warning_counts(r: Relations) -> DataFrame:
    events = r["agentlog_events"]
    recent = _since(events.filter("warnings_json <> '[]'").select("warnings_json", "timestamp_unix_ms"), "timestamp_unix_ms", events, "timestamp_unix_ms", 7 * DAY_MS)
    return recent.groupBy(F.col("warnings_json").alias("warning_category")).agg(F.count("*").alias("warning_count")).orderBy(F.desc("warning_count"), "warning_category").limit(TOP)


def fallback_times_per_adapter(r: Relations) -> DataFrame:
    counts = F.sum(F.when(F.col("timestamp_quality") == "fallback", F.col("event_count")).otherwise(0))
    return r["v_quality"].groupBy("adapter_name").agg(counts.alias("fallback_timestamp_count")).orderBy(F.desc("fallback_timestamp_count"), "adapter_name")


def duplicate_hashes(r: Relations, run_column: str = "run_id") -> DataFrame:
    """Repeated canonical hashes among events whose run is the latest ingest run."""
    latest = r["ingest_runs"].agg(F.max_by("ingest_run_id", F.struct("started_at_utc", "ingest_run_id")).alias(run_column))
    mine = r["agentlog_events"].join(F.broadcast(latest), run_column, "left_semi")
    repeated = mine.groupBy("canonical_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg((F.count("*") > 0).cast("int").alias("has_duplicate_canonical_hashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_count"))


def duplicate_hashes_of_latest_events(r: Relations) -> DataFrame:
    """As duplicate_hashes, over the run that the newest events carry: an ingest run's id never is an event's."""
    events = r["agentlog_events"]
    latest = events.agg(F.max_by("run_id", F.struct("timestamp_unix_ms", "run_id")).alias("run_id"))
    repeated = events.join(F.broadcast(latest), "run_id", "left_semi").groupBy("canonical_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg((F.count("*") > 0).cast("int").alias("has_duplicate_canonical_hashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_count"))


def degraded_run_share(r: Relations) -> DataFrame:
    return r["ingest_runs"].agg(_share(F.count_if(F.col("status").isin("failed", "partial_failure")), F.count("*")).alias("degraded_run_fraction_pct"))


QUESTIONS: dict[str, Callable[[Relations], DataFrame]] = {
    "q-usage-001": calls_per_tool,
    "q-usage-002": sessions_per_day,
    "q-usage-003": events_per_adapter,
    "q-usage-004": calls_per_conversation,
    "q-performance-001": latency_per_tool,
    "q-performance-002": duration_per_session,
    "q-performance-003": slow_share_per_adapter,
    "q-performance-004": hourly_latency_of_top_tools,
    "q-freshness-001": refresh_per_source,
    "q-freshness-002": stale_sources,
    "q-freshness-003": refresh_success_share,
    "q-freshness-004": last_events_written,
    "q-reliability-001": warning_counts,
    "q-reliability-002": fallback_times_per_adapter,
    "q-reliability-003": duplicate_hashes,
    "q-reliability-004": degraded_run_share,
}
