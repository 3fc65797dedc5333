"""Gemini: log arrays and chat sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.jsontext import first_scalar, json_at, present
from loomstone.functions.text import digest
from loomstone.sources.messages import OTHER_KIND, kind_struct
from loomstone.sources.records import Parsed, assemble, at_line, document_problems, first_text, items_of, list_json, notes, object_json, padded, path_mark, text_candidates, timed, variants

# Kinds by role, by level, by kind name.
_PROMPT, _RESPONSE = ("message", "prompt", "user"), ("message", "response", "assistant")
_NOTICE, _OUTPUT = ("system", "system_notice", "system"), ("tool_result", "tool_output", "tool")
_CALL = ("tool_call", "tool_invocation", "tool")
_ERROR, _STATUS = ("diagnostic", "error", "runtime"), ("diagnostic", "status_update", "runtime")
ROLES = {"user": _PROMPT, "assistant": _RESPONSE, "model": _RESPONSE, "gemini": _RESPONSE, "system": _NOTICE, "tool": _OUTPUT}
LEVELS = {"error": _ERROR, "fatal": _ERROR, "warn": _STATUS, "warning": _STATUS}
KINDS = {
    "user": _PROMPT,
    "prompt": _PROMPT,
    "assistant": _RESPONSE,
    "model": _RESPONSE,
    "gemini": _RESPONSE,
    "response": _RESPONSE,
    "tool_call": _CALL,
    "tool_invocation": _CALL,
    "tool": _OUTPUT,
    "tool_result": _OUTPUT,
    "tool_output": _OUTPUT,
    "system": _NOTICE,
    "warn": _STATUS,
    "warning": _STATUS,
    "status": _STATUS,
    "notice": _STATUS,
    "error": _ERROR,
    "fatal": _ERROR,
    "metric": ("diagnostic", "metric", "runtime"),
    "artifact": ("diagnostic", "artifact_reference", "runtime"),
    "artifact_reference": ("diagnostic", "artifact_reference", "runtime"),
}
ID_KEYS = ["event_id", "id", "message_id", "messageId"]
CONVERSATION_KEYS = ["conversation_id", "conversationId", "chat_id", "chatId"]
SESSION_KEYS = ["session_id", "sessionId"]
MODEL_KEYS = ["model", "model_name", "modelName"]
TIME_KEYS = ["timestamp", "created_at", "time"]
CONTENT_KEYS = ["content", "parts", "text", "message", "response", "responses", "candidate", "candidates", "payload"]
CALL_LISTS = ["toolCalls", "tool_calls", "toolcalls"]
CALL_NAMES = ["name", "toolName", "tool", "functionName"]
CALL_IDS = ["id", "toolCallId", "tool_call_id", "callId"]
CALL_ARGUMENTS = ["arguments", "args", "input", "params", "parameters", "functionArgs"]
CALL_RESULTS = ["result", "response", "output", "toolResult", "tool_result", "content"]


def _mapped(name: Column, kinds: dict[str, tuple[str, str, str]]) -> Column:
    """Kind struct of a name in any case; null for other names."""
    low, out = F.lower(name), F.lit(None)
    for key, kind in kinds.items():
        out = F.when(low == key, kind_struct(kind)).otherwise(out)
    return out


def record_kind(role: Column, level: Column, kind: Column) -> Column:
    return F.coalesce(_mapped(role, ROLES), _mapped(level, LEVELS), _mapped(kind, KINDS), kind_struct(OTHER_KIND))


def _ids(v: Column, shape: str) -> tuple[Column, Column]:
    """(id as given, event id)."""
    given, mark = first_scalar(v, *ID_KEYS), path_mark(F.col("source_path"))
    return given, F.coalesce(F.concat(F.lit("gemini-"), mark, F.lit("-"), given), F.concat(F.lit(f"gemini-{shape}-"), mark, F.lit("-"), padded(F.col("line"))))


def _time_notes() -> list[tuple[Column, Column]]:
    return [
        (F.col("stamp").isNull(), at_line("missing timestamp; using fallback", "record")),
        (F.col("stamp").isNotNull() & F.col("parsed_ms").isNull(), at_line(F.concat(F.lit("invalid timestamp `"), "stamp", F.lit("`; using fallback")), "record")),
    ]


def _first_there(v: Column, keys: list[str]) -> Column:
    """JSON text at the first key that is there at all."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(present(v, key), json_at(v, key)).otherwise(out)
    return out


def logs(documents: DataFrame) -> Parsed:
    """A log file: an array of records."""
    v = F.col("v")
    rows = items_of(documents, variants(F.col("root"), "$"), "record")
    given, event_id = _ids(v, "log")
    rows = rows.withColumns({"given": given, "event_id": event_id, "hint": first_scalar(v, "role", "actor", "type"), "level": first_scalar(v, "level", "severity"), "kind": first_scalar(v, "event_type", "kind", "type")})
    rows = timed(rows.withColumn("k", record_kind(F.col("hint"), F.col("level"), F.col("kind"))), first_scalar(v, *TIME_KEYS))
    rows = rows.withColumn("text", first_text(text_candidates(v, "message", "text", "content"))["text"]).withColumn("session", first_scalar(v, *SESSION_KEYS))
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.col("session"),
        "conversation_id": F.coalesce(first_scalar(v, *CONVERSATION_KEYS), F.col("session")),
        "provider": F.lit("google"),
        "model": first_scalar(v, *MODEL_KEYS),
        "content_text": F.col("text"),
        "tags_json": list_json("gemini", "logs_json"),
        "canonical_hash": digest(F.col("event_id"), F.col("source_path"), F.col("line"), F.col("hint"), F.col("level"), F.col("kind"), F.col("text")),
        "metadata_json": object_json({"source_index": F.col("line"), "gemini_level": F.col("level"), "gemini_kind": F.col("kind"), "gemini_source_event_id": F.col("given"), "gemini_session_id_source": F.when(F.col("session").isNotNull(), "record")}),
    }
    found = assemble(rows, "gemini", columns, notes(*_time_notes()), "index")
    wrong = document_problems(documents, F.schema_of_variant("root").startswith("ARRAY"), "gemini logs payload must be a JSON array")
    return Parsed(found.events, found.warnings.unionByName(wrong))


def chats(documents: DataFrame) -> Parsed:
    """A chat session: an object with messages; its own ids and model stand in for a message's."""
    v, root = F.col("v"), F.col("root")
    rows = items_of(documents, variants(root, "$.messages"), "message")
    given, event_id = _ids(v, "chat")
    calls = F.coalesce(*(F.when(present(v, k), F.coalesce(variants(v, f"$.{k}"), F.array(F.try_variant_get(v, f"$.{k}", "variant")))) for k in CALL_LISTS))
    rows = rows.withColumns({"given": given, "event_id": event_id, "hint": first_scalar(v, "role", "author", "actor", "type"), "calls": calls})
    rows = rows.withColumn("call", F.get("calls", F.lit(0)))
    call = F.when(F.schema_of_variant("call").startswith("OBJECT"), F.col("call"))
    rows = rows.withColumns({"tool": first_scalar(call, *CALL_NAMES), "call_id": first_scalar(call, *CALL_IDS), "arguments": _first_there(call, CALL_ARGUMENTS), "result": first_text([("result", _first_there(call, CALL_RESULTS))])["text"]})
    rows = rows.withColumn("said", first_text(text_candidates(v, *CONTENT_KEYS)))
    rows = timed(rows, first_scalar(v, *TIME_KEYS))
    for name, keys in (("conversation", CONVERSATION_KEYS), ("session", SESSION_KEYS), ("model", MODEL_KEYS)):
        rows = rows.withColumn(f"own_{name}", first_scalar(v, *keys)).withColumn(f"root_{name}", first_scalar(root, *keys)).withColumn(name, F.coalesce(f"own_{name}", f"root_{name}"))
    kind = (
        F.when(F.col("result").isNotNull(), kind_struct(_OUTPUT))
        .when(F.col("tool").isNotNull() | F.col("arguments").isNotNull(), kind_struct(_CALL))
        .otherwise(record_kind(F.col("hint"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    )
    rows = rows.withColumn("k", kind)
    source = lambda name: F.when(F.col(f"own_{name}").isNotNull(), "message").when(F.col(f"root_{name}").isNotNull(), "root")
    size = F.coalesce(F.size(variants(v, "$.content")), F.size(variants(v, "$.parts")))
    metadata = {
        "source_index": F.col("line"),
        "gemini_role": F.col("hint"),
        "gemini_root_conversation_id": F.col("root_conversation"),
        "gemini_root_session_id": F.col("root_session"),
        "gemini_root_model": F.col("root_model"),
        "gemini_conversation_id_source": source("conversation"),
        "gemini_session_id_source": source("session"),
        "gemini_model_source": source("model"),
        "gemini_content_source": F.col("said.label"),
        "gemini_source_event_id": F.col("given"),
        "gemini_tool_calls_count": F.when(F.size("calls") > 0, F.size("calls")),
        "gemini_content_parts": size,
    }
    columns = {
        "event_id": F.col("event_id"),
        "record_format": F.col("k.record_format"),
        "event_type": F.col("k.event_type"),
        "role": F.col("k.role"),
        "session_id": F.col("session"),
        "conversation_id": F.col("conversation"),
        "provider": F.lit("google"),
        "model": F.col("model"),
        "content_text": F.col("said.text"),
        "tool_name": F.col("tool"),
        "tool_call_id": F.col("call_id"),
        "tool_arguments_json": F.col("arguments"),
        "tool_result_text": F.col("result"),
        "tags_json": list_json("gemini", "chat_session"),
        "canonical_hash": digest(F.col("event_id"), F.col("conversation"), F.col("session"), F.col("hint"), F.col("said.text"), F.col("line")),
        "metadata_json": object_json(metadata),
    }
    messages = notes(
        (F.col("hint").isNull(), at_line("missing role; mapped to diagnostic runtime event", "message")),
        (~F.lower("hint").isin(*ROLES), at_line(F.concat(F.lit("unknown role `"), "hint", F.lit("`; mapped to diagnostic runtime event")), "message")),
        (F.col("said.text").isNull(), at_line("missing content text; emitting empty content", "message")),
        *_time_notes(),
    )
    found = assemble(rows, "gemini", columns, messages, "messages")
    wrong = document_problems(documents, variants(F.col("root"), "$.messages").isNotNull(), "gemini chat payload must include `messages` array")
    return Parsed(found.events, found.warnings.unionByName(wrong))


def shape_of(path: str) -> str | None:
    """Which parser a file goes to; None for files that aren't read."""
    name = path.rsplit("/", 1)[-1].lower()
    if name == "logs.json":
        return "logs"
    return "chats" if "/chats/" in path or name.startswith("session-") else None


