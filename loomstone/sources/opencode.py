"""OpenCode: session metadata, message parts and auxiliary logs. Normalize doesn't read these; they are for direct use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.jsontext import first_string, string_at
from loomstone.functions.text import digest, key_values
from loomstone.sources import messages
from loomstone.sources.codex import level_type, log_tokens
from loomstone.sources.records import Parsed, assemble, at_line, json_lines, notes, object_json, padded, timed

SESSION_KEYS = ["sessionID", "session_id"]
MESSAGE_KEYS = ["messageID", "message_id"]
PART_KEYS = ["partID", "part_id"]


def session_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, session titles and workspaces) of session metadata lines; lines without a session are left out."""
    v = F.col("v")
    rows = json_lines(lines).filter("problem IS NULL").withColumn("session_id", first_string(v, *SESSION_KEYS)).withColumn("message_id", first_string(v, *MESSAGE_KEYS)).filter("session_id IS NOT NULL")
    found = rows.filter("message_id IS NOT NULL").select(
        "session_id", "message_id", first_string(v, "createdAt", "created_at").alias("created_at"), F.coalesce(string_at(v, "role"), F.lit("unknown")).alias("role"), string_at(v, "model").alias("model"), string_at(v, "provider").alias("provider"), F.col("line").alias("input_seq")
    )
    titles = first_string(v, "title", "sessionTitle", "session_title")
    places = first_string(v, "workspacePath", "workspace_path", "projectPath", "project_path")
    info = rows.filter("message_id IS NULL").select("session_id", "line", titles.alias("t"), places.alias("p"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    return found, info.groupBy("session_id").agg(last("t").alias("title"), last("p").alias("workspace_path"))


def session_rollup(found: DataFrame) -> DataFrame:
    return messages.session_rollup(found)


def is_step(kind: Column) -> Column:
    name = F.lower(F.trim(kind))
    return (name == "step") | name.startswith("step_") | name.endswith("_step") | name.endswith("_event")


def parts(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Parts with a session, message and part id; is_orphan tells those whose message isn't known."""
    v = F.col("v")
    rows = json_lines(lines).filter("problem IS NULL").select(
        first_string(v, *SESSION_KEYS).alias("session_id"),
        first_string(v, *MESSAGE_KEYS).alias("message_id"),
        first_string(v, *PART_KEYS).alias("part_id"),
        F.coalesce(string_at(v, "kind"), F.lit("unknown")).alias("kind"),
        F.when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", F.try_variant_get(v, "$.text", "string")).alias("text"),
    )
    rows = rows.filter("session_id IS NOT NULL AND message_id IS NOT NULL AND part_id IS NOT NULL").withColumn("is_step_event", is_step(F.col("kind")))
    if known is None:
        return rows.withColumn("is_orphan", F.lit(False))
    keys = known.select("session_id", "message_id").distinct().withColumn("__known", F.lit(True))
    return rows.join(keys, ["session_id", "message_id"], "left").withColumn("is_orphan", F.col("__known").isNull()).drop("__known")


def joined(found: DataFrame, of_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages in order with their parts, orphan parts).

    Messages stand by session, created_at (missing first) and id; of equal keys the first in that order
    has the parts.
    """
    order = Window.partitionBy("session_id", "message_id").orderBy(F.asc_nulls_first("created_at"), "input_seq")
    ranked = found.withColumn("input_seq", F.row_number().over(order))
    with_parts, orphans = messages.join_parts(ranked, of_parts.select("session_id", "message_id", "part_id", "kind", "text", "is_step_event"))
    return with_parts.orderBy("session_id", F.asc_nulls_first("created_at"), "message_id"), orphans.orderBy("session_id", "message_id", "part_id")


def auxiliary_log(lines: DataFrame) -> Parsed:
    """Auxiliary logs: time, level, subsystem, an event unless the next token has a =, then key=value tokens."""
    rows = log_tokens(lines)
    problem = F.when(F.size("t") < 4, at_line("unrecognized auxiliary log format; line skipped"))
    named = ~F.get("t", F.lit(3)).contains("=")
    rows = rows.withColumn("problem", problem).withColumns({"level": F.get("t", F.lit(1)), "subsystem": F.get("t", F.lit(2)), "event": F.when(named, F.get("t", F.lit(3))).otherwise("entry"), "rest": F.slice("t", F.when(named, 5).otherwise(4), F.lit(1 << 30))})
    rows = rows.withColumn("fields", key_values(F.col("rest"))).withColumn("text", F.array_join(F.concat(F.array("event"), "rest"), " "))
    rows = timed(rows, F.get("t", F.lit(0)))
    field = lambda name: F.try_element_at("fields", F.lit(name))
    whole = lambda name: F.when(field(name).rlike(r"^\+?\d+$"), field(name).try_cast("long"))
    prompt = F.lower("subsystem").contains("prompt_history")
    event_type = F.when(prompt, "prompt").when(F.lower("event").contains("token_usage"), "metric").otherwise(level_type(F.col("level")))
    tags = F.when(prompt, F.lit('["opencode","prompt_history_auxiliary"]')).otherwise('["opencode","diagnostic_log","runtime_diagnostic"]')
    session = F.coalesce(field("session"), field("session_id"))
    columns = {
        "event_id": F.coalesce(field("message_id"), F.concat(F.lit("opencode-aux-line-"), padded(F.col("line")))),
        "record_format": F.when(prompt, "message").otherwise("diagnostic"),
        "event_type": event_type,
        "role": F.when(prompt, "user").otherwise("runtime"),
        "session_id": session,
        "content_text": F.when(prompt, F.col("text")),
        "input_tokens": whole("prompt"),
        "output_tokens": whole("completion"),
        "total_tokens": whole("prompt") + whole("completion"),
        "tags_json": tags,
        "canonical_hash": digest(F.col("source_path"), F.col("line"), F.col("subsystem"), F.col("event"), session, field("message_id"), F.col("text")),
        "metadata_json": object_json({"source_line": F.col("line"), "opencode_log_level": F.col("level"), "opencode_subsystem": F.col("subsystem"), "opencode_event": F.col("event"), "opencode_fields": F.when(F.size("fields") > 0, F.col("fields"))}),
    }
    messages_of = notes((F.col("parsed_ms").isNull(), at_line(F.concat(F.lit("invalid timestamp `"), "stamp", F.lit("`; using fallback timestamp")))))
    return assemble(rows, "opencode", columns, messages_of)
