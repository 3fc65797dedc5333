"""Codex: rollout and history JSONL, diagnostic logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.jsontext import at, first_present_string, first_string, json_at, string_at
from loomstone.functions.text import digest, key_values, one_spaced
from loomstone.sources.messages import OTHER_KIND, kind_struct, role_kind
from loomstone.sources.records import Parsed, assemble, at_line, first_text, json_lines, list_json, notes, object_json, padded, path_mark, text_candidates, timed

# Kinds by (type of the record, type of its payload).
_STATUS = ("system", "status_update", "runtime")
_NOTICE = ("system", "system_notice", "runtime")
_CALL = ("tool_call", "tool_invocation", "tool")
_OUTPUT = ("tool_result", "tool_output", "tool")
ITEM_KINDS = {"function_call": _CALL, "custom_tool_call": _CALL, "function_call_output": _OUTPUT, "custom_tool_call_output": _OUTPUT, "reasoning": _STATUS}
MESSAGE_KINDS = {"user_message": ("message", "prompt", "user"), "agent_reasoning": _STATUS, "token_count": ("diagnostic", "metric", "runtime")}
TYPE_KINDS = {"session_meta": _NOTICE, "compacted": _NOTICE, "turn_context": _STATUS, "user_prompt": ("message", "prompt", "user"), "assistant_response": ("message", "response", "assistant"), "tool_result": _OUTPUT}
CALL_PREFIXES = {"function_call": "function-call", "function_call_output": "function-call-output", "custom_tool_call": "custom-tool-call", "custom_tool_call_output": "custom-tool-call-output"}
KNOWN_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL"]


def _by_name(name: Column, kinds: dict[str, tuple[str, str, str]], other: Column) -> Column:
    for key, kind in kinds.items():
        other = F.when(name == key, kind_struct(kind)).otherwise(other)
    return other


def message_category(kind: Column) -> Column:
    """meta, progress or generic for an event_msg; null for other types."""
    low = F.lower(kind)
    return F.when(kind.startswith("event_msg"), F.when(low.contains("meta"), "meta").when(low.contains("progress") | low.contains("status"), "progress").otherwise("generic"))


def rollout_kind(kind: Column, payload_type: Column, payload_role: Column) -> Column:
    """struct<record_format, event_type, role> of a rollout record."""
    spoken = F.when(payload_role.isin("user", "assistant", "system"), role_kind(payload_role)).otherwise(kind_struct(("message", "response", "assistant")))
    item = F.when(payload_type == "message", spoken).otherwise(_by_name(payload_type, ITEM_KINDS, kind_struct(OTHER_KIND)))
    category = message_category(kind)
    other = F.when(category == "meta", kind_struct(_NOTICE)).when(category.isNotNull(), kind_struct(_STATUS)).otherwise(_by_name(kind, TYPE_KINDS, kind_struct(OTHER_KIND)))
    return F.when(kind == "response_item", item).when(kind == "event_msg", _by_name(payload_type, MESSAGE_KINDS, kind_struct(_STATUS))).otherwise(other)


def conversation_hash(session: Column, role: Column, text: Column, utc: Column, other: Column) -> Column:
    """What a user or assistant says hashes without its place, so copies in two files are one; other records by `other`."""
    flat = one_spaced(text)
    said = role.isin("user", "assistant") & (flat != "")
    return F.when(said, digest(F.lit("codex.conversation.v1"), session, role, utc, flat)).otherwise(other)


def _stamp_notes() -> list[tuple[Column, Column]]:
    return [
        (F.col("stamp").isNull(), at_line("missing `created_at`; using fallback timestamp")),
        (F.col("stamp").isNotNull() & F.col("parsed_ms").isNull(), at_line("invalid `created_at` value; using fallback timestamp")),
    ]


def rollout(lines: DataFrame) -> Parsed:
    """Rollout records: messages, tool calls and results, notices, metrics."""
    v = F.col("v")
    rows = json_lines(lines)
    rows = rows.withColumns(
        {
            "kind": F.coalesce(first_string(v, "event_type", "type"), F.lit("unknown")),
            "payload_type": string_at(v, "payload.type"),
            "call_id": string_at(v, "payload.call_id"),
            "output": at(v, "payload.output"),
        }
    )
    rows = rows.withColumn("k", rollout_kind(F.col("kind"), F.col("payload_type"), string_at(v, "payload.role")))
    # The first of the time keys that is there at all counts, even if it can't be read.
    rows = timed(rows, first_present_string(v, "created_at", "timestamp", "payload.timestamp"))
    only = lambda condition, pairs: [(label, F.when(condition, c)) for label, c in pairs]
    said = only(F.col("kind") == "response_item", text_candidates(v, "payload.content", "payload.summary"))
    said += only(F.col("kind") == "event_msg", text_candidates(v, "payload.message", "payload.text", "payload.delta"))
    said += text_candidates(v, "text", "message", "response_item", "response_items", "output", "content")
    rows = rows.withColumn("said", first_text(said))
    # A tool's output may be JSON in a string: its own output first, then any text in it, then as it is.
    raw = F.when(F.schema_of_variant("output") == "STRING", F.try_variant_get("output", "$", "string"))
    inner = F.try_parse_json(raw)
    rows = rows.withColumn("told", first_text([("inner", json_at(inner, "output")), ("whole", F.to_json(inner)), ("other", F.when(raw.isNull(), F.to_json("output")))])["text"])
    result = F.coalesce(F.col("told"), raw, string_at(v, "tool_result_text"))
    rows = rows.withColumn("result", result).withColumn("text", F.coalesce("said.text", F.when(F.col("k.record_format") == "tool_result", F.col("result"))))
    prefix = F.when(F.col("kind") == "tool_result", "tool-result").otherwise("tool-event")
    for name, word in CALL_PREFIXES.items():
        prefix = F.when((F.col("kind") == "response_item") & (F.col("payload_type") == name), word).otherwise(prefix)
    mark, n = path_mark(F.col("source_path")), padded(F.col("line"))
    event_id = F.coalesce(first_string(v, "event_id", "payload.id"), F.concat(F.lit("codex-"), prefix, F.lit("-"), mark, F.lit("-line-"), n, F.lit("-"), "call_id"), F.concat(F.lit("codex-rollout-"), mark, F.lit("-line-"), n))
    session = F.coalesce(string_at(v, "session_id"), F.when(F.col("kind") == "session_meta", string_at(v, "payload.id")))
    rows = rows.withColumn("event_id", event_id).withColumn("session", session)
    category = message_category(F.col("kind"))
    suffix = F.nullif(F.trim(F.when(F.col("kind").startswith("event_msg."), F.regexp_replace("kind", "^event_msg\\.", ""))), F.lit(""))
    metadata = object_json(
        {
            "source_line": F.col("line"),
            "codex_source_type": string_at(v, "type"),
            "codex_event_type": F.col("kind"),
            "codex_event_msg_category": category,
            "codex_event_msg_name": F.coalesce(F.when(F.col("kind") == "event_msg", F.col("payload_type")), suffix),
            "codex_content_source": F.col("said.label"),
            "exit_code": F.when(F.schema_of_variant(at(v, "exit_code")) == "BIGINT", F.try_variant_get(v, "$.exit_code", "bigint")),
        }
    )
    own = digest(F.col("session"), F.col("event_id"), F.col("kind"), F.col("text"), F.col("line"))
    known = F.col("kind").isin("user_prompt", "assistant_response", "tool_result", "response_item", "turn_context", "session_meta", "compacted") | F.col("kind").startswith("event_msg")
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.col("session"),
        "content_text": F.col("text"),
        "tool_name": first_string(v, "tool_name", "payload.name"),
        "tool_call_id": first_string(v, "tool_call_id", "payload.call_id"),
        "tool_arguments_json": F.coalesce(json_at(v, "payload.arguments"), json_at(v, "payload.input")),
        "tool_result_text": F.col("result"),
        "tags_json": list_json("codex", "rollout"),
        "canonical_hash": conversation_hash(F.col("session"), F.col("k.role"), F.col("text"), F.col("utc"), own),
        "metadata_json": metadata,
    }
    messages = notes(
        (~known, at_line(F.concat(F.lit("unrecognized `event_type` `"), "kind", F.lit("`; mapped as diagnostic runtime event")))),
        ((F.col("k.record_format") == "message") & F.col("said.text").isNull(), at_line("missing message content text; emitting empty content")),
        *_stamp_notes(),
    )
    return assemble(rows, "codex", columns, messages)


def history(lines: DataFrame) -> Parsed:
    """Prompt history records."""
    v = F.col("v")
    rows = json_lines(lines).withColumn("hint", string_at(v, "role")).withColumn("said", F.lower("hint"))
    rows = timed(rows.withColumn("k", role_kind(F.col("said"))), string_at(v, "created_at"))
    rows = rows.withColumn("text", first_text(text_candidates(v, "content", "text", "message"))["text"])
    rows = rows.withColumn("event_id", F.coalesce(first_string(v, "prompt_id", "event_id"), F.concat(F.lit("codex-history-line-"), padded(F.col("line"))))).withColumn("session", string_at(v, "session_id"))
    own = digest(F.col("session"), F.col("event_id"), F.col("hint"), F.col("text"), F.col("line"))
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.col("session"),
        "content_text": F.col("text"),
        "tags_json": list_json("codex", "history_auxiliary"),
        "canonical_hash": conversation_hash(F.col("session"), F.col("k.role"), F.col("text"), F.col("utc"), own),
        "metadata_json": object_json({"source_line": F.col("line"), "codex_history_source": string_at(v, "source"), "codex_history_role": F.col("hint")}),
    }
    messages = notes(
        (F.col("hint").isNull(), at_line("missing history role; mapped as diagnostic runtime event")),
        (~F.col("said").isin("user", "assistant", "system", "tool"), at_line(F.concat(F.lit("unrecognized history role `"), "said", F.lit("`; mapped as diagnostic runtime event")))),
        (F.col("text").isNull(), at_line("missing content text; emitting empty content")),
        *_stamp_notes(),
    )
    return assemble(rows, "codex", columns, messages)


def level_type(level: Column) -> Column:
    name = F.upper(F.trim(level))
    return F.when(name.isin("ERROR", "FATAL"), "error").when(name.isin("WARN", "WARNING"), "status_update").otherwise("debug_log")


def log_tokens(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with t, their tokens between white space."""
    rows = lines.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).filter("value <> ''")
    return rows.withColumn("t", F.split("value", r"(?U)\s+"))


def diagnostics(lines: DataFrame) -> Parsed:
    """Diagnostic logs: time, level, subsystem, event, then key=value tokens."""
    rows = log_tokens(lines)
    token = lambda i: F.get("t", F.lit(i))
    problem = F.when(F.size("t") < 4, at_line("unrecognized codex log shape; expected `<timestamp> <level> <subsystem> <event> [key=value ...]`"))
    rows = rows.withColumn("problem", problem).withColumns({"level": token(1), "subsystem": token(2), "event": token(3)})
    rows = timed(rows, token(0)).withColumn("tail", F.slice("t", 5, 1 << 30)).withColumn("fields", key_values(F.col("tail")))
    rows = rows.withColumn("text", F.array_join(F.slice("t", 4, 1 << 30), " "))
    place = F.when(F.col("subsystem").contains("desktop"), "desktop_diagnostic").when(F.col("subsystem").contains("tui"), "tui_diagnostic").otherwise("runtime_diagnostic")
    fields = F.when(F.size("fields") > 0, F.col("fields"))
    columns = {
        "event_id": F.concat(F.lit("codex-log-line-"), padded(F.col("line"))),
        "record_format": F.lit("diagnostic"),
        "event_type": level_type(F.col("level")),
        "role": F.lit("runtime"),
        "session_id": F.coalesce(F.try_element_at("fields", F.lit("session")), F.try_element_at("fields", F.lit("session_id"))),
        "content_text": F.col("text"),
        "tags_json": F.to_json(F.array(F.lit("codex"), F.lit("diagnostic_log"), place)),
        "canonical_hash": digest(F.lit("codex.diagnostic.v1"), F.col("stamp"), F.col("level"), F.col("subsystem"), F.col("text")),
        "metadata_json": object_json({"source_line": F.col("line"), "codex_log_level": F.col("level"), "codex_log_subsystem": F.col("subsystem"), "codex_log_event": F.col("event"), "codex_log_fields": fields}),
    }
    messages = notes(
        (F.col("parsed_ms").isNull(), at_line("invalid `created_at` value; using fallback timestamp")),
        (~F.upper("level").isin(*KNOWN_LEVELS), at_line(F.concat(F.lit("unrecognized diagnostic log level `"), "level", F.lit("`; mapped as debug_log")))),
    )
    return assemble(rows, "codex", columns, messages)


