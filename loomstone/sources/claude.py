"""Claude: project sessions with subagents, history, MCP debug logs."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.jsontext import first_string, json_at, present, string_at
from loomstone.functions.text import digest
from loomstone.sources.codex import log_tokens
from loomstone.sources.messages import OTHER_KIND, kind_struct, role_kind
from loomstone.sources.records import Parsed, assemble, at_line, first_text, json_lines, list_json, notes, object_json, padded, path_mark, text_candidates, timed, variants

# Keys of ids, and kinds by name.
ID_KEYS = ["event_id", "entry_id", "trace_id", "id", "uuid", "messageId"]
PARENT_KEYS = ["parent_event_id", "parentUuid", "parent_uuid", "sourceToolAssistantUUID"]
_STATUS = ("system", "status_update", "runtime")


def _spoken(name: Column, more: dict[str, tuple[str, str, str]]) -> Column:
    """Kind struct of user, assistant, system and of the names in `more`; null for others."""
    out = F.when(name.isin("user", "assistant", "system"), role_kind(name))
    for key, kind in more.items():
        out = F.when(name == key, kind_struct(kind)).otherwise(out)
    return out


def _time(rows: DataFrame) -> DataFrame:
    """The first of created_at, timestamp and snapshot.timestamp that is there at all counts, even if it can't be read."""
    v = F.col("v")
    field = F.when(present(v, "created_at"), "created_at").when(present(v, "timestamp"), "timestamp").when(present(v, "snapshot.timestamp"), "snapshot.timestamp")
    stamp = F.when(F.col("field") == "created_at", string_at(v, "created_at")).when(F.col("field") == "timestamp", string_at(v, "timestamp")).otherwise(string_at(v, "snapshot.timestamp"))
    return timed(rows.withColumn("field", field), stamp)


def _time_notes() -> list[tuple[Column, Column]]:
    field = F.coalesce(F.concat(F.lit("`"), "field", F.lit("`")), F.lit("`created_at`/`timestamp`"))
    return [
        (F.col("stamp").isNull(), at_line(F.concat(F.lit("missing "), field, F.lit("; using fallback timestamp")))),
        (F.col("stamp").isNotNull() & F.col("parsed_ms").isNull(), at_line(F.concat(F.lit("invalid "), field, F.lit(" value; using fallback timestamp")))),
    ]


def _said(v: Column) -> list[tuple[str, Column]]:
    """Where conversational text stands: the message's blocks, its text, the message as a whole, then root keys."""
    return [("blocks", json_at(v, "message.content")), *text_candidates(v, "message.text", "message", "text", "content", "input")]


def sessions(lines: DataFrame) -> Parsed:
    """Session records; those that name a parent or subagent session are delegated traces."""
    v = F.col("v")
    rows = json_lines(lines)
    rows = rows.withColumns({"parent": string_at(v, "parent_session_id"), "subagent": string_at(v, "subagent_session_id")})
    rows = rows.withColumn("delegated", F.col("parent").isNotNull() | F.col("subagent").isNotNull())
    blocks = F.filter(F.coalesce(variants(v, "$.message.content"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    rows = rows.withColumn("blocks", blocks).withColumn("kind", F.lower(F.coalesce(first_string(v, "kind", "type"), F.lit("unknown"))))
    of_type = lambda name: F.filter("blocks", lambda x: string_at(x, "type") == name)
    # Calls and results give an id in the order in which they stand; name and input come from calls.
    ids = F.transform("blocks", lambda x: F.when(string_at(x, "type") == "tool_use", string_at(x, "id")).when(string_at(x, "type") == "tool_result", string_at(x, "tool_use_id")))
    first = lambda array: F.get(F.array_compact(array), F.lit(0))
    rows = rows.withColumns(
        {
            "call_id": F.coalesce(first(ids), string_at(v, "tool_call_id")),
            "tool": first(F.transform(of_type("tool_use"), lambda x: string_at(x, "name"))),
            "arguments": first(F.transform(of_type("tool_use"), lambda x: json_at(x, "input"))),
            "failed": F.exists(of_type("tool_result"), lambda x: F.coalesce(F.try_variant_get(x, "$.is_error", "boolean"), F.lit(False))),
        }
    )
    results = F.transform(of_type("tool_result"), lambda x: json_at(x, "content"))
    rows = rows.withColumn("said", first_text(_said(v), ("blocks",))["text"])
    rows = rows.withColumn("result", first_text([(f"result{i}", F.get(results, F.lit(i))) for i in range(4)] + [("rest", F.to_json(F.slice(results, 5, 1 << 30))), ("use", json_at(v, "toolUseResult"))])["text"])
    rows = _time(rows)
    hint = F.lower(F.coalesce(string_at(v, "role"), string_at(v, "message.role")))
    known = _spoken(F.col("kind"), {"progress": _STATUS, "file-history-snapshot": ("system", "artifact_reference", "runtime")})
    hinted = _spoken(hint, {"runtime": _STATUS, "progress": _STATUS})
    plain = (
        F.when(F.col("result").isNotNull(), kind_struct(("tool_result", "tool_output", "tool")))
        .when(F.col("tool").isNotNull() | F.col("arguments").isNotNull(), kind_struct(("tool_call", "tool_invocation", "tool")))
        .otherwise(F.coalesce(known, hinted))
    )
    trace_role = F.coalesce(first_string(v, "role", "type"), F.lit("unknown"))
    trace = _spoken(F.col("trace_role"), {"runtime": _STATUS, "progress": _STATUS})
    rows = rows.withColumn("trace_role", trace_role).withColumn("found", F.when(F.col("delegated"), trace).otherwise(plain)).withColumn("k", F.coalesce("found", kind_struct(OTHER_KIND)))
    mark, n = path_mark(F.col("source_path")), padded(F.col("line"))
    given = first_string(v, *ID_KEYS)
    own_id = F.coalesce(given, F.concat(F.lit("claude-call-"), "call_id"), F.concat(F.lit("claude-"), mark, F.lit("-line-"), n))
    event_id = F.when(F.col("delegated"), F.coalesce(given, F.concat(F.lit("claude-subagent-"), mark, F.lit("-line-"), n))).otherwise(own_id)
    rows = rows.withColumns({"event_id": event_id, "project": first_string(v, "project_id", "projectId", "cwd"), "session": first_string(v, "session_id", "sessionId")})
    own = lambda c: F.when(~F.col("delegated"), c)
    text = F.coalesce("said", own(F.when(F.col("k.record_format") == "tool_result", F.col("result"))))
    rows = rows.withColumn("text", text)
    trace_hash = digest(F.col("parent"), F.col("subagent"), F.col("event_id"), F.col("trace_role"), F.col("text"), F.col("line"))
    own_hash = digest(F.col("project"), F.col("session"), F.col("event_id"), F.col("kind"), F.col("text"), F.col("line"))
    traced = lambda c: F.when(F.col("delegated"), c)
    metadata = {
        "source_line": F.col("line"),
        "claude_record": traced(F.lit("subagent_trace")),
        "delegated_activity": traced(F.lit(True)),
        "subagent_role": traced(F.col("trace_role")),
        "subagent_session_id": F.col("subagent"),
        "parent_session_id": F.col("parent"),
        "claude_kind": own(F.col("kind")),
        "claude_source_type": own(string_at(v, "type")),
        "project_id": own(F.col("project")),
        "tool_result_is_error": own(F.when(F.col("failed"), F.lit(True))),
    }
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.when(F.col("delegated"), F.col("subagent")).otherwise(F.col("session")),
        "conversation_id": F.when(F.col("delegated"), F.col("parent")).otherwise(F.col("project")),
        "parent_event_id": first_string(v, *PARENT_KEYS),
        "actor_id": own(string_at(v, "agentId")),
        "actor_name": own(string_at(v, "slug")),
        "model": own(first_string(v, "message.model", "model")),
        "content_text": F.col("text"),
        "tool_name": own(F.col("tool")),
        "tool_call_id": own(F.col("call_id")),
        "tool_arguments_json": own(F.col("arguments")),
        "tool_result_text": own(F.col("result")),
        "tags_json": F.when(F.col("delegated"), list_json("claude", "subagent_trace", "delegated")).otherwise(list_json("claude", "project_session")),
        "flags_json": F.when(F.col("delegated"), list_json("subagent", "delegated")).when(F.col("failed"), list_json("tool_error")).otherwise("[]"),
        "canonical_hash": F.when(F.col("delegated"), trace_hash).otherwise(own_hash),
        "metadata_json": object_json(metadata),
    }
    messages = notes(
        (F.col("delegated") & F.col("found").isNull(), at_line(F.concat(F.lit("unknown subagent `role` value `"), "trace_role", F.lit("`; mapped to diagnostic event")))),
        (F.col("delegated") & F.col("subagent").isNull(), at_line("missing `subagent_session_id`; preserving event with null session_id")),
        (F.col("delegated") & F.col("parent").isNull(), at_line("missing `parent_session_id`; preserving event with null conversation_id")),
        (~F.col("delegated") & F.col("found").isNull(), at_line(F.concat(F.lit("unknown `kind` value `"), "kind", F.lit("`; mapped to diagnostic event")))),
        *_time_notes(),
    )
    return assemble(rows, "claude", columns, messages)


def history(lines: DataFrame) -> Parsed:
    """History rows: prompts and responses beside the sessions."""
    v = F.col("v")
    rows = _time(json_lines(lines))
    rows = rows.withColumn("said", first_text([("prompt", json_at(v, "prompt")), ("response", json_at(v, "response")), *_said(v)], ("blocks",)))
    guess = F.when(F.col("said.label") == "response", "assistant").otherwise("user")
    rows = rows.withColumn("hint", F.coalesce(first_string(v, "role", "kind", "type"), guess))
    more = {"prompt": ("message", "prompt", "user"), "response": ("message", "response", "assistant"), "runtime": _STATUS, "progress": _STATUS}
    rows = rows.withColumn("found", _spoken(F.col("hint"), more)).withColumn("k", F.coalesce("found", kind_struct(OTHER_KIND)))
    given = F.coalesce(first_string(v, *ID_KEYS), F.concat(F.lit("claude-history-"), path_mark(F.col("source_path")), F.lit("-line-"), padded(F.col("line"))))
    rows = rows.withColumns({"event_id": given, "project": first_string(v, "project_id", "projectId", "cwd"), "session": first_string(v, "session_id", "sessionId")})
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.col("session"),
        "conversation_id": F.col("project"),
        "content_text": F.col("said.text"),
        "tags_json": list_json("claude", "history_auxiliary", "auxiliary"),
        "flags_json": list_json("auxiliary"),
        "canonical_hash": digest(F.col("project"), F.col("session"), F.col("event_id"), F.col("hint"), F.col("said.text"), F.col("line")),
        "metadata_json": object_json({"source_line": F.col("line"), "claude_record": F.lit("history_auxiliary"), "history_role": F.col("hint"), "project_id": F.col("project")}),
    }
    messages = notes(
        (F.col("found").isNull(), at_line(F.concat(F.lit("unknown history `role` value `"), "hint", F.lit("`; mapped to diagnostic event")))),
        (F.col("said.text").isNull(), at_line("missing conversational content in history row")),
        *_time_notes(),
    )
    return assemble(rows, "claude", columns, messages)


def mcp_log(lines: DataFrame) -> Parsed:
    """MCP debug logs: an optional time, level, component, then the message with key=value tokens."""
    rows = log_tokens(lines).withColumn("problem", F.lit(None).cast("string"))
    head = F.get("t", F.lit(0))
    has_time = head.contains("T") & (head.endswith("Z") | head.contains("+") | head.contains("-"))
    rows = rows.withColumn("skip", F.when(has_time, 1).otherwise(0))
    rows = timed(rows, F.when(F.col("skip") == 1, head))
    rows = rows.withColumns(
        {
            "level": F.coalesce(F.get("t", F.col("skip")), F.lit("UNKNOWN")),
            "component": F.coalesce(F.get("t", F.col("skip") + 1), F.lit("claude.mcp")),
            "rest": F.slice("t", F.col("skip") + 3, F.lit(1 << 30)),
        }
    )
    pairs = F.filter("rest", lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.concat(F.lit("log_kv_"), F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.lit(1 << 30)), lambda o: o["key"] == e["key"]))
    fixed = F.array(
        *(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in (("claude_record", F.lit("mcp_cache_debug")), ("log_level", F.col("level")), ("log_component", F.col("component")), ("mcp_action", F.get("rest", F.lit(0)))))
    )
    members = F.map_from_entries(F.filter(F.concat(fixed, last), lambda e: e["value"].isNotNull()))
    # source_line is a number among strings, so it is put in front of the other members.
    metadata = F.concat(F.lit('{"source_line":'), F.col("line").cast("string"), F.lit(","), F.substring(F.to_json(members), 2, 1 << 30))
    text = F.nullif(F.array_join("rest", " "), F.lit(""))
    columns = {
        "event_id": F.concat(F.lit("claude-mcp-log-line-"), padded(F.col("line"))),
        "record_format": F.lit("diagnostic"),
        "event_type": F.when(F.lower("level") == "error", "error").otherwise("debug_log"),
        "role": F.lit("runtime"),
        "content_text": text,
        "tags_json": list_json("claude", "mcp_cache_debug", "auxiliary"),
        "flags_json": list_json("diagnostic", "non_conversational"),
        "canonical_hash": digest(F.col("level"), F.col("component"), F.array_join("rest", " "), F.col("line")),
        "metadata_json": F.to_json(F.try_parse_json(metadata)),
    }
    messages = notes(
        (F.col("skip") == 0, at_line("missing timestamp prefix in MCP cache debug log; using fallback timestamp")),
        ((F.col("skip") == 1) & F.col("parsed_ms").isNull(), at_line("invalid `timestamp` value; using fallback timestamp")),
    )
    return assemble(rows, "claude", columns, messages)


def shape_of(path: str) -> str:
    """Which parser a file goes to, by its name."""
    name = posixpath.basename(path).lower()
    if "mcp_cache" in name or name.endswith((".log", ".txt")):
        return "mcp_log"
    return "history" if "history" in name else "sessions"


