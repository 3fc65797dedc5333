"""The canonical event, its vocabularies, and the mart's tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "agentlog.v1"

# The vocabularies of the canonical event.
ADAPTERS = ["codex", "claude", "gemini", "amp", "opencode"]
RECORD_FORMATS = ["message", "tool_call", "tool_result", "system", "diagnostic"]
EVENT_TYPES = ["prompt", "response", "system_notice", "tool_invocation", "tool_output", "status_update", "error", "metric", "artifact_reference", "debug_log"]
ROLES = ["user", "assistant", "system", "tool", "runtime"]
TIMESTAMP_QUALITIES = ["exact", "derived", "fallback"]
RUN_STATUSES = ["running", "success", "partial_failure", "failed"]
STALENESS_STATES = ["fresh", "stale", "unknown"]

VOCABULARIES = {
    "source_kind": ADAPTERS,
    "adapter_name": ADAPTERS,
    "record_format": RECORD_FORMATS,
    "event_type": EVENT_TYPES,
    "role": ROLES,
    "timestamp_quality": TIMESTAMP_QUALITIES,
}

# Fixed values: (column, type, required) in the mart's order.
_COLUMNS = [
    ("schema_version", "string", True),
    ("event_id", "string", True),
    ("run_id", "string", True),
    ("sequence_global", "long", True),
    ("sequence_source", "long", False),
    ("source_kind", "string", True),
    ("source_path", "string", True),
    ("source_record_locator", "string", True),
    ("source_record_hash", "string", False),
    ("adapter_name", "string", True),
    ("adapter_version", "string", False),
    ("record_format", "string", True),
    ("event_type", "string", True),
    ("role", "string", True),
    ("timestamp_utc", "string", True),
    ("timestamp_unix_ms", "long", True),
    ("timestamp_quality", "string", True),
    ("session_id", "string", False),
    ("conversation_id", "string", False),
    ("turn_id", "string", False),
    ("parent_event_id", "string", False),
    ("actor_id", "string", False),
    ("actor_name", "string", False),
    ("provider", "string", False),
    ("model", "string", False),
    ("content_text", "string", False),
    ("content_excerpt", "string", False),
    ("content_mime", "string", False),
    ("tool_name", "string", False),
    ("tool_call_id", "string", False),
    ("tool_arguments_json", "string", False),
    ("tool_result_text", "string", False),
    ("input_tokens", "long", False),
    ("output_tokens", "long", False),
    ("total_tokens", "long", False),
    ("cost_usd", "double", False),
    ("tags_json", "string", True),
    ("flags_json", "string", True),
    ("pii_redacted", "int", False),
    ("warnings_json", "string", True),
    ("errors_json", "string", True),
    ("raw_hash", "string", True),
    ("canonical_hash", "string", True),
    ("metadata_json", "string", True),
]
_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
#: Columns whose mart name has _json and whose JSONL form is a list or an object.
LIST_COLUMNS = ["tags", "flags", "warnings", "errors"]

EVENT_COLUMNS = [name for name, _, _ in _COLUMNS]
REQUIRED_COLUMNS = [name for name, _, required in _COLUMNS if required]
#: Events as rows of the mart.
EVENTS = T.StructType([T.StructField(name, _KINDS[kind], True) for name, kind, _ in _COLUMNS])
#: Events as objects of a JSONL file: lists are arrays and metadata is JSON text.
JSONL_EVENTS = T.StructType(
    [
        T.StructField(
            name.removesuffix("_json") if name.removesuffix("_json") in [*LIST_COLUMNS, "metadata"] else name,
            T.ArrayType(T.StringType()) if name.removesuffix("_json") in LIST_COLUMNS else T.BooleanType() if name == "pii_redacted" else _KINDS[kind],
            True,
        )
        for name, kind, _ in _COLUMNS
    ]
)
#: Keys that a JSONL object must have.
JSONL_REQUIRED = [c for c in REQUIRED_COLUMNS if c.removesuffix("_json") not in [*LIST_COLUMNS, "metadata"]]

INGEST_RUNS = T.StructType(
    [
        T.StructField("ingest_run_id", T.StringType(), False),
        T.StructField("started_at_utc", T.StringType(), False),
        T.StructField("finished_at_utc", T.StringType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("source_root", T.StringType(), False),
        T.StructField("events_read", T.LongType(), False),
        T.StructField("events_written", T.LongType(), False),
        T.StructField("warnings_count", T.LongType(), False),
        T.StructField("errors_count", T.LongType(), False),
        T.StructField("error_summary_json", T.StringType(), False),
    ]
)
INGEST_WATERMARKS = T.StructType(
    [
        T.StructField("source_key", T.StringType(), False),
        T.StructField("source_kind", T.StringType(), False),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("source_record_locator", T.StringType(), True),
        T.StructField("source_record_hash", T.StringType(), True),
        T.StructField("last_event_timestamp_unix_ms", T.LongType(), True),
        T.StructField("last_ingest_run_id", T.StringType(), True),
        T.StructField("refreshed_at_utc", T.StringType(), False),
        T.StructField("staleness_state", T.StringType(), False),
        T.StructField("metadata_json", T.StringType(), False),
    ]
)
SCHEMA_META = T.StructType([T.StructField("schema_version", T.StringType(), False), T.StructField("applied_at_utc", T.StringType(), False)])
PRIMARY_KEYS = {"agentlog_events": ["event_id"], "ingest_runs": ["ingest_run_id"], "ingest_watermarks": ["source_key"], "agentlog_schema_meta": []}
DEFAULTS = {
    ("agentlog_events", "tags_json"): "'[]'",
    ("agentlog_events", "flags_json"): "'[]'",
    ("agentlog_events", "warnings_json"): "'[]'",
    ("agentlog_events", "errors_json"): "'[]'",
    ("agentlog_events", "metadata_json"): "'{}'",
    ("ingest_runs", "events_read"): "0",
    ("ingest_runs", "events_written"): "0",
    ("ingest_runs", "warnings_count"): "0",
    ("ingest_runs", "errors_count"): "0",
    ("ingest_runs", "error_summary_json"): "'{}'",
    ("ingest_watermarks", "staleness_state"): "'unknown'",
    ("ingest_watermarks", "metadata_json"): "'{}'",
}


def json_schema() -> dict:
    """The canonical event as a JSON Schema document, derived from the column table."""
    kinds = {"string": "string", "long": "integer", "double": "number", "int": "boolean"}
    properties: dict[str, dict] = {}
    required = []
    for name, kind, needed in _COLUMNS:
        short = name.removesuffix("_json")
        if short in LIST_COLUMNS:
            properties[short] = {"type": "array", "items": {"type": "string"}, "default": []}
        elif short == "metadata":
            properties[short] = {"type": "object", "additionalProperties": True, "default": {}}
        else:
            field: dict = {"type": kinds[kind]} if needed else {"type": [kinds[kind], "null"]}
            if kind == "long":
                field["minimum"] = 0
            if name in VOCABULARIES:
                field["enum"] = VOCABULARIES[name]
            properties[name] = field
            if needed:
                required.append(name)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": SCHEMA_VERSION, "type": "object", "additionalProperties": False, "required": required, "properties": properties}
