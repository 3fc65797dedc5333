"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions import redact, text, timeparse
from loomstone.operators import ingest, normalize, parity, snapshot, validate
from loomstone.plans import adapter_queries, product_queries, questions, views
from loomstone.plans.driver_tables import CALLS_CTE, EVENTS_CTE, MARKS_SQL, RUNS_SQL, canonical_events, ledger, table
from loomstone.session import prepare
from loomstone.sources import discovery, history
from loomstone.sources import messages as message_sources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _events_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE} {body}"


def _calls_sql(body: str, more: str = "") -> str:
    return f"WITH {EVENTS_CTE}, {CALLS_CTE}{more} {body}"


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = canonical_events(spark, sf_dir)
    runs, marks = ledger(spark)
    return {"agentlog_events": events, "ingest_runs": runs, "ingest_watermarks": marks} | {n: v(events) for n, v in views.VIEWS.items()}


# --- views

_query("v_tool_calls", _calls_sql("SELECT * FROM v_tool_calls"))(lambda s, d: views.tool_calls(canonical_events(s, d)))
_query(
    "v_sessions",
    _events_sql(
        """SELECT run_id, session_id, min(timestamp_unix_ms) AS first_event_timestamp_unix_ms, max(timestamp_unix_ms) AS last_event_timestamp_unix_ms,
  max(timestamp_unix_ms) - min(timestamp_unix_ms) AS duration_ms, count(*) AS event_count,
  count(*) FILTER (record_format = 'tool_call') AS tool_call_count, count(*) FILTER (record_format = 'tool_result') AS tool_result_count,
  count(*) FILTER (event_type = 'prompt') AS prompt_count, count(*) FILTER (event_type = 'response') AS response_count, count(*) FILTER (event_type = 'error') AS error_count,
  count(DISTINCT conversation_id) AS distinct_conversation_count, count(DISTINCT turn_id) AS distinct_turn_count, count(DISTINCT tool_name) AS distinct_tool_count,
  count(DISTINCT adapter_name) AS distinct_adapter_count
FROM agentlog_events WHERE length(session_id) > 0 GROUP BY ALL"""
    ),
)(lambda s, d: views.sessions(canonical_events(s, d)))
_query(
    "v_adapters",
    _events_sql(
        """SELECT adapter_name, count(*) AS event_count, count(DISTINCT run_id) AS run_count, count(DISTINCT session_id) AS session_count,
  min(timestamp_unix_ms) AS first_event_timestamp_unix_ms, max(timestamp_unix_ms) AS last_event_timestamp_unix_ms,
  count(*) FILTER (event_type = 'prompt') AS prompt_count, count(*) FILTER (event_type = 'response') AS response_count,
  count(*) FILTER (record_format = 'tool_call') AS tool_call_count, count(*) FILTER (record_format = 'tool_result') AS tool_result_count,
  count(*) FILTER (event_type = 'error') AS error_event_count, count(*) FILTER (warnings_json <> '[]') AS warning_record_count,
  count(*) FILTER (errors_json <> '[]') AS error_record_count, count(*) FILTER (pii_redacted = 1) AS pii_redacted_count
FROM agentlog_events GROUP BY adapter_name"""
    ),
)(lambda s, d: views.adapters(canonical_events(s, d)))
_query(
    "v_quality",
    _events_sql(
        """SELECT adapter_name, timestamp_quality, count(*) AS event_count, count(*) FILTER (warnings_json <> '[]') AS warning_record_count,
  count(*) FILTER (errors_json <> '[]') AS error_record_count, count(*) FILTER (flags_json <> '[]') AS flagged_record_count, count(*) FILTER (pii_redacted = 1) AS pii_redacted_count
FROM agentlog_events GROUP BY ALL"""
    ),
)(lambda s, d: views.quality(canonical_events(s, d)))

# --- the sixteen questions

_QUESTION_SQL = {
    "q-usage-001": _calls_sql(
        "SELECT coalesce(tool_name, 'unknown') AS tool_name, count(*) AS invocation_count FROM v_tool_calls WHERE call_event_id IS NOT NULL AND call_timestamp_unix_ms >= (SELECT max(timestamp_unix_ms) FROM agentlog_events) - 7 * 86400000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"
    ),
    "q-usage-002": _events_sql(
        "SELECT strftime(make_timestamp(timestamp_unix_ms * 1000), '%Y-%m-%d') AS day_utc, count(DISTINCT session_id) AS unique_sessions FROM agentlog_events WHERE length(session_id) > 0 AND timestamp_unix_ms >= (SELECT max(timestamp_unix_ms) FROM agentlog_events) - 14 * 86400000 GROUP BY 1"
    ),
    "q-usage-003": _events_sql("SELECT adapter_name, count(*) AS event_count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM agentlog_events), 2) AS event_share_pct FROM agentlog_events GROUP BY 1"),
    "q-usage-004": _calls_sql("SELECT conversation_id, count(*) AS tool_call_count FROM v_tool_calls WHERE call_event_id IS NOT NULL AND length(conversation_id) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "q-performance-001": _calls_sql(
        "SELECT coalesce(tool_name, 'unknown') AS tool_name, list_extract(list_sort(list(duration_ms)), CAST((count(*) + 1) // 2 AS INTEGER)) AS p50_duration_ms, list_extract(list_sort(list(duration_ms)), CAST((95 * count(*) + 99) // 100 AS INTEGER)) AS p95_duration_ms FROM v_tool_calls WHERE pairing_status = 'paired' AND call_timestamp_unix_ms >= (SELECT max(call_timestamp_unix_ms) FROM v_tool_calls) - 86400000 GROUP BY 1"
    ),
    "q-performance-002": _calls_sql("SELECT session_id, CAST(sum(duration_ms) AS BIGINT) AS total_tool_duration_ms FROM v_tool_calls WHERE pairing_status = 'paired' AND length(session_id) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "q-performance-003": _calls_sql("SELECT adapter_name, round(100.0::DOUBLE * count(*) FILTER (duration_ms > 2000) / count(*), 2) AS slow_call_pct FROM v_tool_calls WHERE pairing_status = 'paired' GROUP BY 1"),
    "q-performance-004": _calls_sql(
        "SELECT strftime(make_timestamp(call_timestamp_unix_ms * 1000), '%Y-%m-%dT%H:00:00Z') AS hour_utc, tool AS tool_name, list_extract(list_sort(list(duration_ms)), CAST((count(*) + 1) // 2 AS INTEGER)) AS median_duration_ms FROM paired WHERE tool IN (SELECT tool FROM top) GROUP BY 1, 2",
        ", paired AS (SELECT *, coalesce(tool_name, 'unknown') AS tool FROM v_tool_calls WHERE pairing_status = 'paired'), top AS (SELECT tool, count(*) AS n FROM paired GROUP BY 1 ORDER BY n DESC, tool LIMIT 3)",
    ),
    "q-freshness-001": f"SELECT source_kind, max(refreshed_at_utc) AS last_successful_refresh_at_utc FROM {MARKS_SQL} GROUP BY 1",
    "q-freshness-002": f"SELECT source_key, staleness_state, (max(CAST(epoch(CAST(refreshed_at_utc AS TIMESTAMPTZ)) // 1 AS BIGINT)) OVER () - CAST(epoch(CAST(refreshed_at_utc AS TIMESTAMPTZ)) // 1 AS BIGINT)) * 1000 AS staleness_age_ms FROM {MARKS_SQL} QUALIFY staleness_state = 'stale'",
    "q-freshness-003": f"SELECT round(100.0::DOUBLE * count(*) FILTER (status = 'success') / count(*), 2) AS refresh_success_rate_pct FROM (SELECT status FROM {RUNS_SQL} ORDER BY started_at_utc DESC, ingest_run_id DESC LIMIT 30)",
    "q-freshness-004": f"SELECT CAST(events_written AS BIGINT) AS events_written FROM {RUNS_SQL} WHERE status = 'success' ORDER BY started_at_utc DESC LIMIT 1",
    "q-reliability-001": _events_sql("SELECT warnings_json AS warning_category, count(*) AS warning_count FROM agentlog_events WHERE warnings_json <> '[]' AND timestamp_unix_ms >= (SELECT max(timestamp_unix_ms) FROM agentlog_events) - 7 * 86400000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "q-reliability-002": _events_sql("SELECT adapter_name, count(*) FILTER (timestamp_quality = 'fallback') AS fallback_timestamp_count FROM agentlog_events GROUP BY 1"),
    "q-reliability-003": _events_sql(
        f"SELECT CAST(count(*) > 0 AS INTEGER) AS has_duplicate_canonical_hashes, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM agentlog_events WHERE run_id = (SELECT ingest_run_id FROM {RUNS_SQL} ORDER BY started_at_utc DESC LIMIT 1) GROUP BY canonical_hash HAVING count(*) > 1)"
    ),
    "q-reliability-004": f"SELECT round(100.0::DOUBLE * count(*) FILTER (status IN ('failed', 'partial_failure')) / count(*), 2) AS degraded_run_fraction_pct FROM {RUNS_SQL}",
}
for _id, _plan in questions.QUESTIONS.items():
    _query(_id.replace("-", "_"), _QUESTION_SQL[_id])(lambda s, d, plan=_plan: plan(_relations(s, d)))
_query(
    "q_reliability_003_event_runs",
    _events_sql(
        "SELECT CAST(count(*) > 0 AS INTEGER) AS has_duplicate_canonical_hashes, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM agentlog_events WHERE run_id = (SELECT run_id FROM agentlog_events ORDER BY timestamp_unix_ms DESC, run_id DESC LIMIT 1) GROUP BY canonical_hash HAVING count(*) > 1)"
    ),
)(lambda s, d: questions.duplicate_hashes_of_latest_events(_relations(s, d)))

# --- normalize

_RANK = "CASE timestamp_quality WHEN 'exact' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END"
_ORDER = f"timestamp_unix_ms, {_RANK}, source_kind, source_path, source_record_locator, sequence_source NULLS LAST, canonical_hash, event_id"


def _ordered_events(s: SparkSession, d: str) -> DataFrame:
    return canonical_events(s, d).withColumn("input_seq", F.col("event_id").cast("long"))


@_query(
    "dedupe_canonical",
    _events_sql(
        f"""SELECT arg_min(event_id, row(rank, -metadata_n, event_id)) AS event_id, 'canonical_hash' AS dedupe_strategy, CAST(count(DISTINCT event_id) AS INTEGER) AS dedupe_count,
  string_agg(event_id, ',' ORDER BY event_id) AS members, string_agg(source_record_locator, ',' ORDER BY CAST(event_id AS BIGINT)) AS provenance
FROM (SELECT *, {_RANK} AS rank FROM agentlog_events) GROUP BY canonical_hash"""
    ),
)
def dedupe_canonical(s: SparkSession, d: str) -> DataFrame:
    folded = normalize.dedupe(_ordered_events(s, d))
    return folded.select("event_id", "dedupe_strategy", "dedupe_count", F.array_join("dedupe_members", ",").alias("members"), F.array_join("provenance.source_record_locator", ",").alias("provenance"))


@_query(
    "dedupe_fallback_keys",
    _events_sql(
        """SELECT CASE WHEN content_text IS NOT NULL THEN 'a:' || source_kind || '|' || conversation_id || '||' || role || '|' || content_text ELSE 'b:' || source_kind || '|' || source_path || '|' || source_record_locator END AS dedupe_key,
  count(*) AS n FROM agentlog_events GROUP BY 1"""
    ),
)
def dedupe_fallback_keys(s: SparkSession, d: str) -> DataFrame:
    bare = canonical_events(s, d).withColumn("canonical_hash", F.lit(" ")).withColumn("turn_id", F.lit(None).cast("string"))
    bare = bare.withColumn("conversation_id", F.when(F.col("content_text").isNotNull(), F.col("conversation_id")))
    return bare.withColumn("dedupe_strategy", normalize.strategy()).groupBy(normalize.dedupe_key().alias("dedupe_key")).agg(F.count("*").alias("n"))


@_query("total_order_sequence", _events_sql(f"SELECT event_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS sequence_global FROM agentlog_events"))
def total_order_sequence(s: SparkSession, d: str) -> DataFrame:
    return normalize.total_order_at_scale(s, canonical_events(s, d)).select("event_id", "sequence_global")


_HISTOGRAM_SQL = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, v AS value, (SELECT count(*) FROM agentlog_events WHERE {dim} = v) AS n FROM (SELECT unnest({words}) AS v)"
    for dim, words in (("adapter_name", schema.ADAPTERS), ("source_kind", schema.ADAPTERS), ("record_format", schema.RECORD_FORMATS), ("event_type", schema.EVENT_TYPES), ("timestamp_quality", schema.TIMESTAMP_QUALITIES))
)
_query("stats_histograms", _events_sql(_HISTOGRAM_SQL))(lambda s, d: normalize.histograms(canonical_events(s, d)))

# --- ingest


@_query(
    "upsert_last_wins",
    _events_sql(
        """, versions AS (SELECT 'k-' || (CAST(event_id AS BIGINT) % 997) AS event_id, source_path, timestamp_unix_ms, CAST(event_id AS BIGINT) AS line FROM agentlog_events),
old AS (SELECT 'k-' || i AS event_id, 'old' AS source_path, CAST(i AS BIGINT) AS timestamp_unix_ms, -1 AS line FROM range(0, 1500) t(i))
SELECT event_id, arg_max(source_path, line) AS source_path, arg_max(timestamp_unix_ms, line) AS timestamp_unix_ms FROM (SELECT * FROM versions UNION ALL SELECT * FROM old) GROUP BY 1"""
    ).replace(" , versions", ", versions"),
)
def upsert_last_wins(s: SparkSession, d: str) -> DataFrame:
    new = canonical_events(s, d).select(F.concat(F.lit("k-"), (F.col("event_id").cast("long") % 997).cast("string")).alias("event_id"), "source_path", "timestamp_unix_ms", F.col("event_id").cast("long").alias("line"))
    old = s.range(1500).select(F.concat(F.lit("k-"), F.col("id").cast("string")).alias("event_id"), F.lit("old").alias("source_path"), F.col("id").alias("timestamp_unix_ms"))
    return ingest.upsert(old, new, "event_id", "line")


_FRONTIER = "SELECT source_kind || '|' || source_path AS source_key, source_kind, source_path, source_record_locator, source_record_hash, timestamp_unix_ms AS last_event_timestamp_unix_ms FROM {t} QUALIFY row_number() OVER (PARTITION BY source_kind, source_path ORDER BY timestamp_unix_ms DESC, CAST(event_id AS BIGINT) DESC) = 1"
_query("source_frontier", _events_sql(_FRONTIER.format(t="agentlog_events")))(lambda s, d: ingest.frontier(_ordered_events(s, d), "input_seq"))


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frontiers of two refreshes: the second lacks a source and sees the others' later events."""
    events = _ordered_events(s, d)
    first = events.filter(F.col("input_seq") % 3 != 0)
    second = events.filter((F.col("source_path") != "/src/codex/0") & ((F.col("input_seq") % 2 == 0) | (F.col("source_kind") == "amp")))
    return ingest.frontier(first, "input_seq"), ingest.frontier(second, "input_seq")


_HALVES = (
    ", first_refresh AS (" + _FRONTIER.format(t="(SELECT * FROM agentlog_events WHERE CAST(event_id AS BIGINT) % 3 <> 0)") + "), second_refresh AS (" + _FRONTIER.format(t="(SELECT * FROM agentlog_events WHERE source_path <> '/src/codex/0' AND (CAST(event_id AS BIGINT) % 2 = 0 OR source_kind = 'amp'))") + ")"
)
_DECIDED = """SELECT coalesce(n.source_key, o.source_key) AS source_key,
  CASE WHEN n.source_key IS NULL THEN 'missing_in_latest_refresh' WHEN o.source_key IS NULL THEN 'no_prior_watermark'
    WHEN n.last_event_timestamp_unix_ms > o.last_event_timestamp_unix_ms THEN 'advanced_timestamp' WHEN n.last_event_timestamp_unix_ms < o.last_event_timestamp_unix_ms THEN 'regressed_timestamp'
    WHEN n.source_record_locator IS DISTINCT FROM o.source_record_locator OR n.source_record_hash IS DISTINCT FROM o.source_record_hash THEN 'changed_marker' ELSE 'unchanged_frontier' END AS reason,
  CASE WHEN n.source_key IS NULL THEN 'stale' ELSE 'fresh' END AS staleness_state
FROM second_refresh n FULL JOIN first_refresh o USING (source_key)"""


def _two_refreshes(s: SparkSession, d: str) -> DataFrame:
    first, second = _halves(s, d)
    empty = s.createDataFrame([], schema.INGEST_WATERMARKS)
    old = ingest.watermarks(empty, first, "ingest-1", "2024-02-01T00:00:00.000Z")
    return ingest.watermarks(old, second, "ingest-2", "2024-02-02T00:00:00.000Z")


@_query("incremental_decision", _events_sql(_HALVES + " " + _DECIDED).replace(" , first_refresh", ", first_refresh"))
def incremental_decision(s: SparkSession, d: str) -> DataFrame:
    return _two_refreshes(s, d).select("source_key", F.get_json_object("metadata_json", "$.decision_reason").alias("reason"), "staleness_state")


@_query("staleness_rollup", _events_sql(_HALVES + f" SELECT staleness_state, count(*) AS sources FROM ({_DECIDED}) GROUP BY 1").replace(" , first_refresh", ", first_refresh"))
def staleness_rollup(s: SparkSession, d: str) -> DataFrame:
    return _two_refreshes(s, d).groupBy("staleness_state").agg(F.count("*").alias("sources"))


@_query(
    "parity_diff",
    _events_sql(
        """SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 101 = 0 THEN 'missing_right' ELSE 'tool_name' END AS field, CASE WHEN CAST(event_id AS BIGINT) % 101 = 0 THEN 'row is only on the left' ELSE 'values differ' END AS detail
FROM agentlog_events WHERE CAST(event_id AS BIGINT) % 101 = 0 OR (CAST(event_id AS BIGINT) % 89 = 0 AND tool_name IS DISTINCT FROM 'changed')"""
    ),
)
def parity_diff(s: SparkSession, d: str) -> DataFrame:
    left = canonical_events(s, d)
    n = F.col("event_id").cast("long")
    right = left.filter(n % 101 != 0).withColumn("tool_name", F.when(n % 89 == 0, F.lit("changed")).otherwise(F.col("tool_name")))
    return parity.differences(left, right)


# --- joins and rollups

_query("orphan_anti_join", _calls_sql("SELECT result_event_id, tool_call_id FROM v_tool_calls WHERE pairing_status = 'orphan_result'"))(lambda s, d: views.tool_calls(canonical_events(s, d)).filter("pairing_status = 'orphan_result'").select("result_event_id", "tool_call_id"))


@_query(
    "message_parts_join",
    """WITH m AS (SELECT 's-' || (conv_id % 50) AS session_id, 'm-' || turn AS message_id, conv_id, turn, role FROM conversations),
p AS (SELECT 's-' || (conv_id % 50) AS session_id, 'm-' || (turn + 1) AS message_id, 'p-' || conv_id || '-' || turn AS part_id FROM conversations),
parts AS (SELECT session_id, message_id, string_agg(part_id, ',' ORDER BY part_id) AS part_ids, count(*) AS n FROM p GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id, message_id ORDER BY conv_id) AS place FROM m)
SELECT session_id, message_id, CAST(conv_id AS VARCHAR) AS seq, coalesce(CASE WHEN place = 1 THEN part_ids END, '') AS part_ids FROM placed LEFT JOIN parts USING (session_id, message_id)""",
)
def message_parts_join(s: SparkSession, d: str) -> DataFrame:
    talk = table(s, d, "conversations")
    session = F.concat(F.lit("s-"), (F.col("conv_id") % 50).cast("string")).alias("session_id")
    messages = talk.select(session, F.concat(F.lit("m-"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("input_seq"))
    parts = talk.select(session, F.concat(F.lit("m-"), (F.col("turn") + 1).cast("string")).alias("message_id"), F.concat_ws("-", F.lit("p"), "conv_id", "turn").alias("part_id"))
    joined, _ = message_sources.join_parts(messages, parts)
    return joined.select("session_id", "message_id", F.col("input_seq").cast("string").alias("seq"), F.array_join("parts.part_id", ",").alias("part_ids"))


@_query(
    "session_rollup_sets",
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS message_count, min(lpad(CAST(turn AS VARCHAR), 4, '0')) AS first_created_at, max(lpad(CAST(turn AS VARCHAR), 4, '0')) AS last_created_at, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id",
)
def session_rollup_sets(s: SparkSession, d: str) -> DataFrame:
    talk = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("created_at"), "role", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("provider"))
    return message_sources.session_rollup(talk).select("session_id", "message_count", "first_created_at", "last_created_at", F.array_join("roles", ",").alias("roles"))


# --- validation


@_query(
    "validation_issues",
    _events_sql(
        """, talk AS (SELECT CAST(event_id AS BIGINT) AS line, content_text FROM agentlog_events WHERE record_format = 'message')
SELECT line, 'invariant_violation' AS kind, 'warning' AS severity, 'content_text is empty for user/assistant message record' AS detail FROM talk WHERE content_text IS NULL
UNION ALL SELECT CAST(event_id AS BIGINT), 'invariant_violation', 'error', 'timestamp mismatch: timestamp_utc=' || timestamp_unix_ms || ', timestamp_unix_ms=' || (timestamp_unix_ms + 1) FROM agentlog_events WHERE CAST(event_id AS BIGINT) % 37 = 0
UNION ALL SELECT CAST(event_id AS BIGINT), 'invariant_violation', 'error', 'raw_hash must be non-empty' FROM agentlog_events WHERE CAST(event_id AS BIGINT) % 41 = 0"""
    ).replace(" , talk", ", talk"),
)
def validation_issues(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("long")
    events = canonical_events(s, d).withColumn("line", n).withColumn("timestamp_unix_ms", F.when(n % 37 == 0, F.col("timestamp_unix_ms") + 1).otherwise(F.col("timestamp_unix_ms"))).withColumn("raw_hash", F.when(n % 41 == 0, F.lit(" ")).otherwise(F.col("raw_hash")))
    return validate.invariant_issues(events)


@_query(
    "quality_scorecard",
    _events_sql(
        """SELECT count(*) AS sound, count(*) FILTER (record_format = 'message') AS talk, count(content_text) FILTER (record_format = 'message') AS with_text,
  count(*) FILTER (timestamp_quality = 'exact') AS exact, count(*) FILTER (timestamp_quality = 'derived') AS derived, count(*) FILTER (timestamp_quality = 'fallback') AS fallback FROM agentlog_events"""
    ),
)
def quality_scorecard(s: SparkSession, d: str) -> DataFrame:
    return validate.scorecard_counts(canonical_events(s, d))


# --- scalars

_WS = r"[\s\x0B\x1C-\x1F\x85\xA0]+"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_query("excerpt_280", f"SELECT doc_id, CASE WHEN length({_FLAT}) > 280 THEN substr({_FLAT}, 1, 280) || '...' ELSE nullif({_FLAT}, '') END AS excerpt FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt")))
_query("whitespace_normalize", f"SELECT doc_id, md5({_FLAT}) AS digest FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.one_spaced(F.col("text")).cast("binary")).alias("digest")))
_query("truncate_240", "SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 237) || '...' ELSE text END AS short FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", text.truncated(F.col("text"), 240).alias("short")))


@_query(
    "epoch_unit_inference",
    """SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS from_s, (epoch_us(ts) // 1000) AS from_ms, (epoch_us(ts) // 1000) AS from_us, (epoch_us(ts) // 1000) AS from_ns, (epoch_us(ts) // 1000) AS from_text FROM events""",
)
def epoch_unit_inference(s: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(s, d, "events").select("event_id", ms.alias("ms"))
    number = lambda c: c.cast("string")
    return rows.select(
        "event_id",
        timeparse.parse_ms(number(F.expr("ms div 1000"))).alias("from_s"),
        timeparse.parse_ms(number(F.col("ms"))).alias("from_ms"),
        timeparse.parse_ms(number(F.col("ms") * 1000)).alias("from_us"),
        timeparse.parse_ms(number(F.col("ms").cast("decimal(38,0)") * 1_000_000)).alias("from_ns"),
        timeparse.parse_ms(timeparse.format_ms(F.col("ms"))).alias("from_text"),
    )


_query("format_unix_ms", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events")(lambda s, d: table(s, d, "events").select("event_id", timeparse.format_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("stamp")))
_query("day_bucket", "SELECT strftime(ts, '%Y-%m-%d') AS day_utc, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(timeparse.day_bucket(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day_utc")).agg(F.count("*").alias("n")))
_query("hour_bucket", "SELECT strftime(ts, '%Y-%m-%dT%H:00:00Z') AS hour_utc, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(timeparse.hour_bucket(F.unix_millis(F.col("ts").cast("timestamp"))).alias("hour_utc")).agg(F.count("*").alias("n")))


@_query("derived_durations", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id WHEN event_id % 5 < 3 THEN event_id % 5 WHEN event_id % 2 = 0 THEN 7 END AS duration_ms, CASE WHEN event_id % 5 = 0 THEN 'explicit' WHEN event_id % 5 < 3 THEN 'paired' WHEN event_id % 2 = 0 THEN 'heuristic' END AS source FROM events")
def derived_durations(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    found = timeparse.duration(F.when(n % 5 == 0, n), F.lit(1000), F.when(n % 5 < 3, F.lit(1000) + n % 5).otherwise(F.lit(10)), F.when(n % 2 == 0, F.lit(7)))
    return table(s, d, "events").select("event_id", found.alias("x")).select("event_id", "x.duration_ms", "x.source")


@_query(
    "percentile_nearest_rank",
    "SELECT event_type, list_extract(list_sort(list(user_id)), CAST((count(*) + 1) // 2 AS INTEGER)) AS p50, list_extract(list_sort(list(user_id)), CAST((95 * count(*) + 99) // 100 AS INTEGER)) AS p95 FROM events GROUP BY 1",
)
def percentile_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    return questions.nearest_rank(table(s, d, "events").select("event_type", "user_id"), ["event_type"], "user_id", {"p50": (1, 1, 2), "p95": (95, 99, 100)})


_query("topk", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(50))

# --- snapshot and redaction


@_query(
    "evenly_spaced_sample",
    """WITH placed AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM placed WHERE i IN (0, (n - 1 + 1) // 2, n - 1) OR n <= 3""",
)
def evenly_spaced_sample(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "event_id", F.lit(None).cast("string").alias("event_kind"))
    return snapshot.sampled(rows, ["user_id"], ["event_id"], 3).select("user_id", "event_id")


_query("json_event_kind", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").select(snapshot.event_kind(F.try_parse_json(F.to_json(F.struct(F.lit(" ").alias("event_type"), F.col("event_type").alias("kind"))))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
)


@_query("json_key_profile", "SELECT 'k' AS path, 'number' AS value_type, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_key_profile(s: SparkSession, d: str) -> DataFrame:
    return snapshot.key_profile(table(s, d, "events").select(F.lit("events").alias("source"), F.col("props").alias("value"))).select("path", "value_type", F.col("occurrences").alias("n"))


# SQL's regular expressions know only ASCII word boundaries, so this has no SQL; a test holds it against plain Python.
_query("redact_documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(redact.redacted(F.col("text")).cast("binary")).alias("digest")))

# --- classifiers and discovery

_query(
    "classify_role",
    "SELECT role, CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'message' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool_result' ELSE 'diagnostic' END AS record_format, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' WHEN 'system' THEN 'system_notice' WHEN 'tool' THEN 'tool_output' ELSE 'debug_log' END AS event_type, count(*) AS n FROM conversations GROUP BY ALL",
)(lambda s, d: message_sources.with_role_kind(table(s, d, "conversations"), "role").groupBy("role", "record_format", "event_type").agg(F.count("*").alias("n")))


@_query(
    "history_scores",
    "SELECT adapter, score FROM (SELECT unnest(['amp', 'claude', 'codex', 'gemini', 'opencode']) AS adapter, unnest([(SELECT count(*) FROM events WHERE event_type = 'view' AND user_id % 2 = 0), (SELECT count(*) FROM events WHERE event_type = 'click'), (SELECT count(*) FROM events WHERE event_type = 'purchase'), (SELECT count(*) FROM events WHERE event_type = 'signup'), 0]) AS score)",
)
def history_scores(s: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("event_type") == "click", "claude --resume").when(F.col("event_type") == "purchase", "codex exec x").when(F.col("event_type") == "signup", "gemini chat").when((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0), "amp run").otherwise("ls -l")
    lines = table(s, d, "events").select(F.concat(F.lit(": 1700000000:0;"), command).alias("value"))
    return history.scores(history.commands(lines)).select("adapter", "score")


# Written out, so that a change of the registry shows.
@_query(
    "known_paths",
    """SELECT * FROM (VALUES ('codex', 10, '~/.codex/sessions', 'session_store', 'directory', true), ('codex', 20, '~/.codex/history.jsonl', 'history_stream', 'jsonl', false), ('codex', 30, '~/.codex/log', 'runtime_diagnostics', 'text_log', true),
  ('claude', 10, '~/.claude/projects', 'session_store', 'directory', true), ('claude', 20, '~/.claude/statsig', 'runtime_diagnostics', 'text_log', true), ('claude', 30, '~/.claude.json', 'config_metadata', 'json', false),
  ('gemini', 10, '~/.gemini/tmp', 'session_store', 'directory', true), ('gemini', 20, '~/.gemini/history', 'history_stream', 'directory', true), ('gemini', 30, '~/.gemini/debug', 'runtime_diagnostics', 'text_log', true),
  ('amp', 10, '~/.amp/sessions', 'session_store', 'directory', true), ('amp', 20, '~/.amp/history', 'history_stream', 'directory', true), ('amp', 30, '~/.amp/logs', 'runtime_diagnostics', 'text_log', true), ('amp', 40, '~/.amp/file-changes', 'session_store', 'directory', true),
  ('opencode', 10, '~/.opencode/project', 'session_store', 'directory', true), ('opencode', 20, '~/.opencode/sessions', 'session_store', 'directory', true), ('opencode', 30, '~/.opencode/logs', 'runtime_diagnostics', 'text_log', true)) AS t(adapter, precedence, path, role, format_hint, recursive)""",
)
def known_paths(s: SparkSession, d: str) -> DataFrame:
    return discovery.registry(s)


# --- adapters

for _name, (_plan, _sql) in (adapter_queries.QUERIES | product_queries.QUERIES).items():
    _query(_name, _sql)(_plan)

# --- engine-inherited SQL over the star schema (any query of the plane may use these)

_PASSTHROUGH = {
    "sql_join_aggregate": "SELECT n_name, count(*) AS orders_n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi_anti": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 1000)",
    "sql_set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1",
    "sql_window_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 40) SELECT n FROM t",
}


def _star(sql: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        for name in ("orders", "customer", "nation", "supplier"):
            table(s, d, name).createOrReplaceTempView(name)
        return s.sql(sql)

    return run


for _name, _sql in _PASSTHROUGH.items():
    _query(_name, _sql)(_star(_sql))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
