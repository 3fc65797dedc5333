"""Canonical events, ledgers and messages made from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions.timeparse import format_ms

ADAPTER_OF = {i: a for i, a in enumerate(schema.ADAPTERS)}
#: event_type of the table -> (record_format, event_type, role).
KIND_OF = {
    "click": ("tool_call", "tool_invocation", "tool"),
    "view": ("tool_result", "tool_output", "tool"),
    "purchase": ("message", "prompt", "user"),
    "signup": ("message", "response", "assistant"),
    "error": ("diagnostic", "error", "runtime"),
}
RUNS_SQL = "(VALUES " + ", ".join(
    f"('ingest-{i:04d}', '2024-01-{1 + i // 2:02d}T{(i % 2) * 12:02d}:00:00.000Z', '{['success', 'success', 'failed', 'success', 'partial_failure', 'running'][i % 6]}', {100 + 7 * i}, {90 + 7 * i})" for i in range(40)
) + ") AS t(ingest_run_id, started_at_utc, status, events_read, events_written)"
MARKS_SQL = "(VALUES " + ", ".join(
    f"('{schema.ADAPTERS[i % 5]}|/src/{schema.ADAPTERS[i % 5]}/{i // 5}', '{schema.ADAPTERS[i % 5]}', '/src/{schema.ADAPTERS[i % 5]}/{i // 5}', '2024-01-{20 + i % 9:02d}T0{i % 7}:15:{i:02d}.000Z', '{['fresh', 'stale', 'unknown'][i % 3]}')" for i in range(35)
) + ") AS t(source_key, source_kind, source_path, refreshed_at_utc, staleness_state)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as canonical events; one narrow projection over the scan."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    base = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for t, v in KIND_OF.items() for x in (t, v[i]))), F.col("event_type"))
    adapter = F.element_at(F.array(*(F.lit(a) for a in schema.ADAPTERS)), (F.col("user_id") % 5 + 1).cast("int"))
    user, event, k = F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("k")
    tool = F.col("event_type").isin("click", "view")
    listed = lambda n, word: F.when(k % n == 0, F.concat(F.lit(f'["{word}-'), (k % 4).cast("string"), F.lit('"]'))).otherwise("[]")
    row = {
        "schema_version": F.lit(schema.SCHEMA_VERSION),
        "event_id": event,
        "run_id": F.concat(F.lit("run-"), (F.col("event_id") % 4).cast("string")),
        "sequence_global": F.col("event_id"),
        "sequence_source": F.when(k % 7 != 0, F.col("event_id")),
        "source_kind": adapter,
        "source_path": F.concat(F.lit("/src/"), adapter, F.lit("/"), (F.col("user_id") % 7).cast("string")),
        "source_record_locator": F.concat(F.lit("line:"), event),
        "source_record_hash": F.md5(event.cast("binary")),
        "adapter_name": adapter,
        "record_format": of(0),
        "event_type": of(1),
        "role": of(2),
        "timestamp_utc": format_ms(F.col("ms")),
        "timestamp_unix_ms": F.col("ms"),
        "timestamp_quality": F.element_at(F.array(*(F.lit(q) for q in schema.TIMESTAMP_QUALITIES)), (k % 3 + 1).cast("int")),
        "session_id": F.when(k % 11 == 0, None).when(k % 13 == 0, "").otherwise(F.concat(F.lit("s-"), user)),
        "conversation_id": F.concat(F.lit("c-"), (F.col("user_id") % 20).cast("string")),
        "turn_id": F.concat(F.lit("t-"), (F.col("event_id") % 50).cast("string")),
        "content_text": F.when(F.col("event_type").isin("purchase", "signup") & (k % 5 != 0), F.concat(F.lit("value "), F.floor("value").cast("string"))),
        "tool_name": F.when(tool & (k % 6 != 5), F.concat(F.lit("tool-"), (k % 6).cast("string"))),
        "tool_call_id": F.when(tool, F.concat(F.lit("tc-"), F.floor(F.col("event_id") / 16).cast("string"))),
        "tags_json": F.lit("[]"),
        "flags_json": listed(19, "flag"),
        "pii_redacted": F.when(k % 23 == 0, 1).when(k % 7 == 3, None).otherwise(0),
        "warnings_json": listed(10, "warning"),
        "errors_json": listed(17, "error"),
        "raw_hash": F.md5(event.cast("binary")),
        "canonical_hash": F.md5(F.concat_ws("|", "event_type", user, F.floor("value").cast("string")).cast("binary")),
        "metadata_json": F.when(k % 2 == 0, F.lit('{"a":1,"b":2}')).otherwise(F.lit('{"a":1}')),
    }
    return base.select(*(row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.EVENTS))


def ledger(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(ingest_runs, ingest_watermarks) of fixed rows."""
    return spark.sql(f"SELECT * FROM {RUNS_SQL}"), spark.sql(f"SELECT * FROM {MARKS_SQL}")


_CASE = lambda column, i: f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{v[i]}'" for t, v in KIND_OF.items()) + " END"
_LISTED = lambda n, word: f"CASE WHEN k % {n} = 0 THEN '[\"{word}-' || (k % 4) || '\"]' ELSE '[]' END"
#: CTEs that give agentlog_events, runs and marks in DuckDB.
EVENTS_CTE = f"""
raw AS (SELECT event_id, user_id, event_type AS et, value, (epoch_us(ts) // 1000) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  list_extract({schema.ADAPTERS}, CAST(user_id % 5 + 1 AS INTEGER)) AS adapter FROM events),
agentlog_events AS (SELECT
  CAST(event_id AS VARCHAR) AS event_id, 'run-' || (event_id % 4) AS run_id, CASE WHEN k % 7 <> 0 THEN event_id END AS sequence_source,
  adapter AS source_kind, adapter AS adapter_name, '/src/' || adapter || '/' || (user_id % 7) AS source_path, 'line:' || event_id AS source_record_locator,
  md5(CAST(event_id AS VARCHAR)) AS source_record_hash, md5(CAST(event_id AS VARCHAR)) AS raw_hash,
  {_CASE('et', 0)} AS record_format, {_CASE('et', 1)} AS event_type, {_CASE('et', 2)} AS role,
  strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_utc, ms AS timestamp_unix_ms,
  list_extract({schema.TIMESTAMP_QUALITIES}, CAST(k % 3 + 1 AS INTEGER)) AS timestamp_quality,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE 's-' || user_id END AS session_id,
  'c-' || (user_id % 20) AS conversation_id, 't-' || (event_id % 50) AS turn_id,
  CASE WHEN et IN ('purchase', 'signup') AND k % 5 <> 0 THEN 'value ' || CAST(floor(value) AS BIGINT) END AS content_text,
  CASE WHEN et IN ('click', 'view') AND k % 6 <> 5 THEN 'tool-' || (k % 6) END AS tool_name,
  CASE WHEN et IN ('click', 'view') THEN 'tc-' || (event_id // 16) END AS tool_call_id,
  {_LISTED(19, 'flag')} AS flags_json, {_LISTED(10, 'warning')} AS warnings_json, {_LISTED(17, 'error')} AS errors_json,
  CASE WHEN k % 23 = 0 THEN 1 WHEN k % 7 = 3 THEN NULL ELSE 0 END AS pii_redacted,
  md5(et || '|' || user_id || '|' || CAST(floor(value) AS BIGINT)) AS canonical_hash,
  CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS metadata_n FROM raw)"""
CALLS_CTE = """
answers AS (SELECT run_id, tool_call_id, event_id AS result_event_id, timestamp_unix_ms AS result_ms, tool_name AS answer_tool FROM agentlog_events
  WHERE record_format = 'tool_result' AND tool_call_id <> '' QUALIFY row_number() OVER (PARTITION BY run_id, tool_call_id ORDER BY timestamp_unix_ms, event_id) = 1),
calls AS (SELECT * FROM agentlog_events WHERE record_format = 'tool_call'),
v_tool_calls AS (
  SELECT c.run_id, c.session_id, c.conversation_id, c.turn_id, c.adapter_name, c.source_kind, coalesce(c.tool_name, a.answer_tool) AS tool_name, c.tool_call_id,
    c.event_id AS call_event_id, a.result_event_id, c.timestamp_unix_ms AS call_timestamp_unix_ms, a.result_ms AS result_timestamp_unix_ms,
    CASE WHEN a.result_ms >= c.timestamp_unix_ms THEN a.result_ms - c.timestamp_unix_ms END AS duration_ms,
    CASE WHEN a.result_ms >= c.timestamp_unix_ms THEN 'paired' END AS duration_source, CASE WHEN a.result_ms >= c.timestamp_unix_ms THEN 'medium' END AS duration_quality,
    CASE WHEN a.result_ms IS NULL THEN 'missing_result' WHEN a.result_ms < c.timestamp_unix_ms THEN 'invalid_order' ELSE 'paired' END AS pairing_status
  FROM calls c LEFT JOIN answers a USING (run_id, tool_call_id)
  UNION ALL BY NAME
  SELECT run_id, session_id, conversation_id, turn_id, adapter_name, source_kind, tool_name, tool_call_id, NULL AS call_event_id, event_id AS result_event_id,
    NULL::BIGINT AS call_timestamp_unix_ms, timestamp_unix_ms AS result_timestamp_unix_ms, NULL::BIGINT AS duration_ms, NULL AS duration_source, NULL AS duration_quality, 'orphan_result' AS pairing_status
  FROM agentlog_events r WHERE record_format = 'tool_result' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.run_id = r.run_id AND c.tool_call_id = r.tool_call_id))"""
