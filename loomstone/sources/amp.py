"""Amp: file-change events, thread envelopes, auxiliary records, file-change telemetry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.jsontext import TEXT_KEYS, json_at, present, scalar_at, string_at, text_of
from loomstone.functions.text import digest, excerpt, truncated_bytes
from loomstone.sources.records import Parsed, assemble, document_problems, first_text, json_lines, list_json, notes, object_json, padded, path_mark, text_candidates, timed, variants

# Keys of a file change, and the blob limit where none is given.
BLOB_LIMIT = 4096
THREAD_KEYS = ["thread_id", "threadId", "thread", "conversation_id", "conversationId"]
SESSION_KEYS = ["session_id", "sessionId", "session"]
URI_KEYS = ["uri", "path", "file", "file_path"]
ID_KEYS = ["event_id", "id", "change_id", "changeId"]
TIME_KEYS = ["timestamp", "created_at", "time", "ts"]
TOOL_KEYS = ["tool_name", "tool", "source_tool"]
CALL_KEYS = ["tool_call_id", "toolCallId", "call_id", "callId"]
AUXILIARY_TEXT = ["summary", "text", "message", "note", "description", "prompt"]
AUXILIARY_KEYS = ["event_id", "history_id", "id", "kind", "type", "event", "thread_id", "thread", "session_id", "session", "role", "created_at", "timestamp", "ts"]
LIMIT_STATES = ["at_limit", "over_limit", "too_large"]


def first_there(v: Column, keys: list[str], value=scalar_at) -> Column:
    """The value at the first key that is there at all; if that can't be used, null."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(present(v, key), value(v, key)).otherwise(out)
    return out


def flag_at(v: Column, *keys: str) -> Column:
    """The first key that holds a boolean or its name."""
    found = []
    for key in keys:
        word = F.lower(F.trim(F.try_variant_get(v, f"$.{key}", "string")))
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        found.append(F.when(kind.isin("BOOLEAN", "STRING"), F.when(word == "true", True).when(word == "false", False)))
    return F.coalesce(*found)


def file_changes(documents: DataFrame) -> Parsed:
    """File-change files: one object, or an array of them; each is a tool's result."""
    v = F.col("v")
    rooted = documents.withColumn("root", F.try_parse_json("value"))
    kind = F.schema_of_variant("root")
    single = rooted.filter(kind.startswith("OBJECT")).select("source_path", F.lit(1).cast("long").alias("line"), F.to_json("root").alias("value"), F.col("root").alias("v"), F.lit("json:root").alias("locator"), F.lit(None).cast("string").alias("problem"))
    listed = rooted.select("source_path", F.posexplode(variants(F.col("root"), "$")).alias("at", "v")).withColumn("line", (F.col("at") + 1).cast("long"))
    bad = F.when(~F.schema_of_variant("v").startswith("OBJECT"), F.concat(F.lit("item "), F.col("line").cast("string"), F.lit(": expected object in amp file-change array; skipped")))
    many = listed.select("source_path", "line", F.to_json("v").alias("value"), "v", F.concat(F.lit("items:"), F.col("line").cast("string")).alias("locator"), bad.alias("problem"))
    rows = single.unionByName(many)
    segments = F.split("source_path", "/")
    part = lambda mark: F.get(F.filter(segments, lambda s: s.startswith(mark)), F.lit(0))
    rows = rows.withColumn("thread", F.coalesce(first_there(v, THREAD_KEYS), part("T-")))
    rows = rows.withColumn("session", F.coalesce(first_there(v, SESSION_KEYS), part("S-"), F.col("thread"))).withColumn("uri", first_there(v, URI_KEYS))
    made = F.concat(F.lit("amp-file-change-"), path_mark(F.col("source_path")), F.lit("-"), padded(F.col("line") - 1))
    rows = rows.withColumn("event_id", F.coalesce(first_there(v, ID_KEYS), made))
    rows = rows.withColumns({k: first_text(text_candidates(v, k))["text"] for k in ("diff", "before", "after")})
    both = F.nullif(F.concat_ws("\n\n", F.concat(F.lit("before:\n"), "before"), F.concat(F.lit("after:\n"), "after")), F.lit(""))
    rows = timed(rows.withColumn("text", F.coalesce("diff", both)), first_there(v, TIME_KEYS))
    columns = {
        "event_id": F.col("event_id"),
        "source_record_locator": F.col("locator"),
        "sequence_global": F.lit(0),
        "record_format": F.lit("tool_result"),
        "event_type": F.lit("tool_output"),
        "role": F.lit("tool"),
        "session_id": F.col("session"),
        "conversation_id": F.col("thread"),
        "content_text": F.col("text"),
        "content_mime": F.when(F.col("diff").isNotNull(), "text/x-diff").otherwise("text/plain"),
        "tool_name": first_there(v, TOOL_KEYS),
        "tool_call_id": first_there(v, CALL_KEYS),
        "tool_arguments_json": first_there(v, ["arguments", "input"], json_at),
        "tool_result_text": F.col("text"),
        "tags_json": list_json("amp", "file_change", "tool_result"),
        "flags_json": list_json("auxiliary"),
        "canonical_hash": digest(F.lit("amp.file_change.v1"), F.col("event_id"), F.col("source_path"), F.col("locator"), F.col("session"), F.col("thread"), F.col("uri"), F.col("text"), F.col("ms")),
        "metadata_json": object_json({"source_record": F.col("locator"), "uri": F.col("uri"), "is_new_file": flag_at(v, "isNewFile", "is_new_file"), "reverted": flag_at(v, "reverted"), "thread_id": F.col("thread"), "session_id": F.col("session")}),
    }
    where = lambda text: F.concat(F.col("locator"), F.lit(": "), text if isinstance(text, Column) else F.lit(text))
    messages = notes(
        (F.col("text").isNull(), where("amp file-change record has no diff/before/after payload")),
        (F.col("stamp").isNull(), where("missing timestamp; using fallback")),
        (F.col("stamp").isNotNull() & F.col("parsed_ms").isNull(), where(F.concat(F.lit("invalid timestamp `"), "stamp", F.lit("`; using fallback")))),
    )
    found = assemble(rows, "amp", columns, messages)
    wrong = document_problems(documents, F.schema_of_variant("root").rlike("^(OBJECT|ARRAY)"), "amp file-change event root must be an object or array of objects")
    return Parsed(found.events, found.warnings.unionByName(wrong))


def auxiliary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(auxiliary records, lines that are left out with their reason); copies of thread messages are left out."""
    v = F.col("v")
    rows = json_lines(lines)
    copy = present(v, "message_id") & present(v, "role") & (present(v, "parts") | present(v, "content"))
    reason = F.coalesce("problem", F.when(copy, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": skipped likely duplicate thread message payload in auxiliary stream"))))
    rows = rows.withColumn("reason", reason)
    text = first_text(text_candidates(v, *AUXILIARY_TEXT))["text"]
    kept = rows.filter("reason IS NULL").withColumn("content_text", text)
    strings = lambda *keys: first_there(v, list(keys), string_at)
    records = kept.select(
        "source_path",
        "line",
        F.coalesce(strings("event_id", "history_id", "id"), F.concat(F.lit("amp-aux-line-"), padded(F.col("line")))).alias("record_id"),
        F.coalesce(strings("kind", "type", "event"), F.lit("auxiliary")).alias("record_kind"),
        strings("thread_id", "thread").alias("thread_id"),
        strings("session_id", "session").alias("session_id"),
        strings("role").alias("role"),
        strings("created_at", "timestamp", "ts").alias("created_at"),
        "content_text",
        excerpt(F.col("content_text")).alias("content_excerpt"),
        F.array_sort(F.array_except(F.json_object_keys("value"), F.array(*(F.lit(k) for k in [*AUXILIARY_KEYS, *AUXILIARY_TEXT])))).alias("metadata_keys"),
    )
    return records, rows.filter("reason IS NOT NULL").select("source_path", "line", "reason")


def _is_typed(items: list) -> bool:
    return any(isinstance(x, dict) and "type" in x for x in items)


def _part_text(part: dict) -> str | None:
    for key in [k for k in TEXT_KEYS if k not in ("content", "parts")]:
        if text := text_of(part.get(key)):
            return text
    content = part.get("content")
    if isinstance(content, list) and _is_typed(content) or not isinstance(content, (str, list)):
        return None
    return text_of(content)


def typed_parts(parts: list, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, text) of all typed parts, outer before inner; places are joined by dots."""
    todo = [(path, parts)]
    while todo:
        above, items = todo.pop()
        if isinstance(items, dict):
            kind = items.get("type")
            yield above, kind.strip() if isinstance(kind, str) and kind.strip() else "unknown", _part_text(items)
            inner = [items.get("parts"), items.get("content")]
            todo += [(above, x) for x in reversed(inner) if isinstance(x, list) and _is_typed(x)]
            continue
        todo += [(f"{above}.{i}" if above else str(i), x) for i, x in reversed(list(enumerate(items))) if isinstance(x, dict)]


def thread_messages(documents: DataFrame) -> DataFrame:
    """(source_path, thread_id, session_id, message_index, message_id, role, created_at, part_count, parts) of thread envelopes.

    Parts nest to any depth, so they are flattened in Python; a message without an id or role is left out.
    """
    rooted = documents.withColumn("root", F.try_parse_json("value"))
    root, v = F.col("root"), F.col("v")
    rows = rooted.filter(string_at(root, "thread_id").isNotNull()).select("source_path", string_at(root, "thread_id").alias("thread_id"), string_at(root, "session_id").alias("session_id"), F.posexplode(variants(root, "$.messages")).alias("message_index", "v"))

    @F.pandas_udf("array<struct<path string, kind string, text string>>")
    def flattened(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            out = []
            for text in texts:
                value = json.loads(text) if text is not None else None
                out.append([{"path": p, "kind": k, "text": t} for p, k, t in typed_parts(value)] if isinstance(value, list) else [])
            yield pd.Series(out, dtype=object)

    kept = rows.select("source_path", "thread_id", "session_id", "message_index", string_at(v, "id").alias("message_id"), string_at(v, "role").alias("role"), string_at(v, "created_at").alias("created_at"), F.coalesce(F.size(variants(v, "$.parts")), F.lit(0)).alias("part_count"), flattened(json_at(v, "parts")).alias("parts"))
    texts = F.array_compact(F.transform("parts", lambda p: p["text"]))
    kept = kept.filter("message_id IS NOT NULL AND role IS NOT NULL")
    return kept.withColumn("content_text", F.nullif(F.array_join(texts, "\n"), F.lit(""))).withColumn("content_excerpt", excerpt(F.col("content_text")))


def thread_rollup(messages: DataFrame) -> DataFrame:
    """A row for each thread: messages, first and last created_at as text, sorted roles."""
    return messages.groupBy("source_path", "thread_id", "session_id").agg(F.count("*").alias("message_count"), F.min("created_at").alias("first_created_at"), F.max("created_at").alias("last_created_at"), F.array_sort(F.collect_set("role")).alias("roles_seen"))


def blob_limit(root: Column) -> Column:
    """The limit as a whole number or its text, else the default."""
    kind = F.schema_of_variant(F.try_variant_get(root, "$.blob_limit_bytes", "variant"))
    found = F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(root, "$.blob_limit_bytes", "string").try_cast("long"))
    return F.when(found >= 0, found).otherwise(F.lit(BLOB_LIMIT).cast("long"))


def _blob(v: Column, limit: Column, *keys: str) -> Column:
    """struct<preview, size_bytes, truncated> of the first key that is there: a string as it is, other JSON as text."""
    raw = F.lit(None).cast("string")
    for key in reversed(keys):
        here = F.try_variant_get(v, f"$.{key}", "variant")
        text = F.when(F.schema_of_variant(here) == "STRING", F.try_variant_get(v, f"$.{key}", "string")).when(F.schema_of_variant(here) != "VOID", F.to_json(here))
        raw = F.when(present(v, key), text).otherwise(raw)
    size = F.octet_length(raw)
    return F.struct(F.when(size > 0, truncated_bytes(raw, limit)).alias("preview"), size.cast("long").alias("size_bytes"), F.coalesce(size > limit, F.lit(False)).alias("truncated"))


def change_telemetry(documents: DataFrame) -> DataFrame:
    """A row for each file change of a telemetry file, with previews of at most the file's blob limit."""
    rooted = documents.withColumn("root", F.try_parse_json("value")).withColumn("blob_limit_bytes", blob_limit(F.col("root")))
    items = F.coalesce(variants(F.col("root"), "$.file_changes"), variants(F.col("root"), "$.changes"))
    v = F.col("v")
    rows = rooted.select("source_path", string_at(F.col("root"), "thread_id").alias("thread_id"), "blob_limit_bytes", F.posexplode(items).alias("at", "v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    strings = lambda *keys: first_there(v, list(keys), string_at)
    return rows.select(
        "source_path",
        "thread_id",
        "blob_limit_bytes",
        "at",
        F.coalesce(strings("path", "file_path", "file", "filename"), F.lit("unknown")).alias("path"),
        F.coalesce(strings("operation", "op", "action", "type"), F.lit("unknown")).alias("operation"),
        strings(*TOOL_KEYS).alias("tool_name"),
        _blob(v, F.col("blob_limit_bytes"), "before", "old", "old_content").alias("before"),
        _blob(v, F.col("blob_limit_bytes"), "after", "new", "new_content").alias("after"),
    )


def attachments(documents: DataFrame) -> DataFrame:
    """A row for each attachment of a telemetry file; at_or_over_limit by size or by status."""
    rooted = documents.withColumn("root", F.try_parse_json("value")).withColumn("blob_limit_bytes", blob_limit(F.col("root")))
    v = F.col("v")
    rows = rooted.select("source_path", "blob_limit_bytes", F.posexplode(variants(F.col("root"), "$.attachments")).alias("at", "v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    whole = lambda key: F.try_variant_get(v, f"$.{key}", "string").try_cast("long")
    size = F.coalesce(*(F.when(whole(k) >= 0, whole(k)) for k in ("size_bytes", "size", "bytes")))
    rows = rows.withColumn("size_bytes", size).withColumn("status", F.coalesce(string_at(v, "status"), F.lit("unknown")))
    given = first_there(v, ["attachment_id", "id"], string_at)
    over = F.coalesce(F.col("size_bytes") >= F.col("blob_limit_bytes"), F.lit(False)) | F.col("status").isin(*LIMIT_STATES)
    return rows.select("source_path", F.coalesce(given, F.concat(F.lit("attachment-"), F.lpad(F.col("at").cast("string"), 3, "0"))).alias("attachment_id"), "size_bytes", "status", over.alias("at_or_over_limit"))


def artifact_rollup(changes: DataFrame, attached: DataFrame) -> DataFrame:
    """A row for each telemetry file: distinct paths and tools, truncated blobs, attachments over the limit."""
    mine = changes.groupBy("source_path").agg(F.array_sort(F.collect_set("path")).alias("paths_seen"), F.array_sort(F.collect_set("tool_name")).alias("tools_seen"), F.count_if(F.col("before.truncated") | F.col("after.truncated")).alias("truncated_blobs"))
    over = attached.groupBy("source_path").agg(F.count_if("at_or_over_limit").alias("over_limit_attachments"))
    return mine.join(over, "source_path", "full_outer").select("source_path", "paths_seen", "tools_seen", F.coalesce("truncated_blobs", F.lit(0)).alias("truncated_blobs"), F.coalesce("over_limit_attachments", F.lit(0)).alias("over_limit_attachments"))


