"""Queries that turn the driver's tables into raw agent files and read those back through the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import redact
from loomstone.functions.timeparse import format_ms
from loomstone.plans.driver_tables import table
from loomstone.scratch import written
from loomstone.sources import amp, claude, codex, gemini, opencode
from loomstone.sources.records import Parsed, lines_of

#: Rows of a made file, so that none grows with the table.
FILE_ROWS = 1000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as text, in numbered files."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", ms.alias("ms"))
    return rows.withColumn("at", format_ms(F.col("ms"))).withColumn("file", F.floor(F.col("event_id") / FILE_ROWS).cast("long"))


def _files(rows: DataFrame, line: Column, folder: str, ending: str) -> DataFrame:
    """(source_path, value): one text per file, a line per row by id."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.concat(F.lit(f"{folder}/f"), F.col("file").cast("string"), F.lit(ending)).alias("source_path")).agg(joined.alias("value"))


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in members.items())))


def _lists(rows: DataFrame, member: Column, folder: str, wrap: Callable[[Column], Column]) -> DataFrame:
    """(source_path, value): one JSON text per file that holds a list, an item per row by id."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", member.alias("item")))), lambda x: x["item"]), ",")
    return rows.groupBy(F.concat(F.lit(f"{folder}/f"), F.col("file").cast("string")).alias("source_path")).agg(wrap(F.concat(F.lit("["), items, F.lit("]"))).alias("value"))


def _kinds(parsed: Parsed) -> DataFrame:
    """(record_format, event_type, role, timestamp_quality, n, ms, chars) of parsed events."""
    counts = parsed.events.groupBy("record_format", "event_type", "role", "timestamp_quality").agg(
        F.count("*").alias("n"), F.sum(F.col("timestamp_unix_ms").cast("decimal(38,0)")).alias("ms"), F.coalesce(F.sum(F.char_length("content_text")), F.lit(0)).cast("long").alias("chars")
    )
    return whole_ms(parsed.events.sparkSession, counts)


def whole_ms(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """`counts` by kind, whose ms is a sum of times as decimal(38,0).

    ms is a long as in the SQL; if some kind's times sum to more than a long holds, where the SQL only
    fails, it is decimal(38,0). So that the type is known, the counts, a row for each kind, are written first.
    """
    ms = F.col("ms")
    found = written(spark, counts)
    beyond = found.filter(ms.isNotNull() & ms.try_cast("long").isNull())
    return found.withColumn("ms", ms.cast("long")) if beyond.isEmpty() else found


_MS = "(epoch_us(ts) // 1000)"


def _kinds_sql(cases: dict[str, tuple[str, str, str]], chars: str, where: str = "TRUE") -> str:
    """The same counts from the events table: event_type -> kind."""
    of = lambda i: "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{k[i]}'" for t, k in cases.items()) + " END"
    return f"SELECT {of(0)} AS record_format, {of(1)} AS event_type, {of(2)} AS role, 'exact' AS timestamp_quality, count(*) AS n, CAST(sum({_MS}) AS BIGINT) AS ms, CAST(coalesce(sum({chars}), 0) AS BIGINT) AS chars FROM events WHERE {where} GROUP BY 1, 2, 3"


def _said() -> Column:
    return F.concat(F.lit("text of "), F.col("event_id").cast("string"))


_SAID_CHARS = "length('text of ' || event_id)"
_PROMPT, _RESPONSE, _OUTPUT = ("message", "prompt", "user"), ("message", "response", "assistant"), ("tool_result", "tool_output", "tool")
_CALL, _STATUS, _DEBUG = ("tool_call", "tool_invocation", "tool"), ("system", "status_update", "runtime"), ("diagnostic", "debug_log", "runtime")


def _named(names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("event_type"))


def codex_rollout(s: SparkSession, d: str) -> DataFrame:
    kind = _named({"click": "user_prompt", "view": "assistant_response", "purchase": "tool_result", "signup": "event_msg.progress", "error": "odd"})
    line = _json(event_type=kind, created_at=F.col("at"), text=_said())
    return _kinds(codex.rollout(lines_of(_files(_rows(s, d), line, "/c", ".jsonl"))))


def codex_history(s: SparkSession, d: str) -> DataFrame:
    role = _named({"click": "user", "view": "Assistant", "purchase": "tool", "signup": "system", "error": "x"})
    return _kinds(codex.history(lines_of(_files(_rows(s, d), _json(role=role, created_at=F.col("at"), content=F.array(_said())), "/c", ".jsonl"))))


def codex_log(s: SparkSession, d: str) -> DataFrame:
    level = _named({"click": "INFO", "view": "WARN", "purchase": "ERROR", "signup": "FATAL", "error": "DEBUG"})
    line = F.concat_ws("  ", "at", level, F.lit("codex.tui"), F.lit("tick"), F.concat(F.lit("k="), "event_id"))
    return _kinds(codex.diagnostics(lines_of(_files(_rows(s, d), line, "/c", ".log"))))


def claude_sessions(s: SparkSession, d: str) -> DataFrame:
    kind = _named({"click": "user", "view": "assistant", "purchase": "progress", "signup": "user", "error": "odd"})
    block = F.when(F.col("event_type") == "signup", F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), "event_id").alias("tool_use_id"), _said().alias("content"), F.lit(None).cast("string").alias("text")))).otherwise(
        F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"), _said().alias("text")))
    )
    line = _json(type=kind, timestamp=F.col("at"), message=F.struct(block.alias("content")))
    return _kinds(claude.sessions(lines_of(_files(_rows(s, d), line, "/p", ".jsonl"))))


def claude_history(s: SparkSession, d: str) -> DataFrame:
    asked = F.col("event_type").isin("click", "purchase", "error")
    line = _json(prompt=F.when(asked, _said()), response=F.when(~asked, _said()), created_at=F.col("at"))
    return _kinds(claude.history(lines_of(_files(_rows(s, d), line, "/p", ".jsonl"))))


def claude_mcp_log(s: SparkSession, d: str) -> DataFrame:
    level = _named({"click": "info", "view": "warn", "purchase": "Error", "signup": "debug", "error": "trace"})
    return _kinds(claude.mcp_log(lines_of(_files(_rows(s, d), F.concat_ws(" ", "at", level, F.lit("mcp"), F.lit("hit"), F.concat(F.lit("k="), "event_id")), "/p", ".log"))))


def gemini_logs(s: SparkSession, d: str) -> DataFrame:
    item = _json(kind=_named({"click": "prompt", "view": "response", "purchase": "tool_call", "signup": "notice", "error": "metric"}), timestamp=F.col("ms"), message=_said())
    return _kinds(gemini.logs(_lists(_rows(s, d), item, "/g", lambda x: x)))


def gemini_chats(s: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit("ls").alias("name"), F.struct(F.lit(1).alias("x")).alias("args"))))
    item = _json(role=_named({"click": "user", "view": "model", "purchase": "gemini", "signup": "tool", "error": "x"}), timestamp=F.col("at"), toolCalls=call, parts=F.array(F.struct(_said().alias("text"))))
    return _kinds(gemini.chats(_lists(_rows(s, d), item, "/g/chats", lambda x: F.concat(F.lit('{"sessionId":"s","messages":'), x, F.lit("}")))))


def amp_file_changes(s: SparkSession, d: str) -> DataFrame:
    item = _json(uri=F.concat(F.lit("f"), "event_id"), diff=F.when(F.col("event_type") != "view", _said()), after=F.when(F.col("event_type") == "view", _said()), timestamp=F.col("at"))
    return _kinds(amp.file_changes(_lists(_rows(s, d), item, "/h/.amp/file-changes/T-1", lambda x: x)))


def opencode_log(s: SparkSession, d: str) -> DataFrame:
    subsystem = F.when(F.col("event_type") == "click", "prompt_history").otherwise("usage")
    event = F.when(F.col("event_type") == "view", "token_usage").otherwise("tick")
    line = F.concat_ws(" ", "at", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), subsystem, event, F.concat(F.lit("prompt="), "event_id"), F.lit("completion=2"))
    found = opencode.auxiliary_log(lines_of(_files(_rows(s, d), line, "/o", ".log"))).events
    return found.groupBy("record_format", "event_type", "role").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


def amp_thread_rollup(s: SparkSession, d: str) -> DataFrame:
    talk = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    message = _json(id=F.concat(F.lit("m"), F.col("turn").cast("string")), role=F.col("role"), created_at=F.lpad(F.col("turn").cast("string"), 4, "0"), parts=F.array(part, F.struct(F.lit("step").alias("type"), F.lit(None).cast("string").alias("text"))))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",")
    documents = talk.groupBy("conv_id").agg(items.alias("items")).select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string")).alias("source_path"), F.concat(F.lit('{"thread_id":"'), F.col("conv_id").cast("string"), F.lit('","messages":['), "items", F.lit("]}")).alias("value"))
    found = amp.thread_rollup(amp.thread_messages(documents))
    return found.select("thread_id", "message_count", "first_created_at", "last_created_at", F.array_join("roles_seen", ",").alias("roles"))


def redaction_classes(s: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("user"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "@mail.example.org").otherwise(""), F.when(F.col("event_id") % 5 == 0, " password=abc").otherwise(""), F.when(F.col("event_id") % 7 == 0, " Bearer abcdefgh1").otherwise(""))
    rows = table(s, d, "events").select(redact.redaction(made).alias("r"))
    return rows.select(F.array_join("r.classes", ",").alias("classes"), "r.pii_redacted").groupBy("classes", "pii_redacted").agg(F.count("*").alias("n"))


QUERIES = {
    "adapter_codex_rollout": (codex_rollout, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _OUTPUT, "signup": _STATUS, "error": _DEBUG}, _SAID_CHARS)),
    "adapter_codex_history": (codex_history, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _OUTPUT, "signup": ("system", "system_notice", "system"), "error": _DEBUG}, _SAID_CHARS)),
    "adapter_codex_log": (codex_log, _kinds_sql({"click": _DEBUG, "view": ("diagnostic", "status_update", "runtime"), "purchase": ("diagnostic", "error", "runtime"), "signup": ("diagnostic", "error", "runtime"), "error": _DEBUG}, "length('tick k=' || event_id)")),
    "adapter_claude_sessions": (claude_sessions, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _STATUS, "signup": _OUTPUT, "error": _DEBUG}, _SAID_CHARS)),
    "adapter_claude_history": (claude_history, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _PROMPT, "signup": _RESPONSE, "error": _PROMPT}, _SAID_CHARS)),
    "adapter_claude_mcp_log": (claude_mcp_log, _kinds_sql({"click": _DEBUG, "view": _DEBUG, "purchase": ("diagnostic", "error", "runtime"), "signup": _DEBUG, "error": _DEBUG}, "length('hit k=' || event_id)")),
    "adapter_gemini_logs": (gemini_logs, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _CALL, "signup": ("diagnostic", "status_update", "runtime"), "error": ("diagnostic", "metric", "runtime")}, _SAID_CHARS)),
    "adapter_gemini_chats": (gemini_chats, _kinds_sql({"click": _PROMPT, "view": _RESPONSE, "purchase": _CALL, "signup": _OUTPUT, "error": _DEBUG}, _SAID_CHARS)),
    "adapter_amp_file_changes": (amp_file_changes, _kinds_sql(dict.fromkeys(("click", "view", "purchase", "signup", "error"), _OUTPUT), f"{_SAID_CHARS} + CASE WHEN event_type = 'view' THEN 7 ELSE 0 END")),
    "adapter_opencode_log": (
        opencode_log,
        "SELECT CASE event_type WHEN 'click' THEN 'message' ELSE 'diagnostic' END AS record_format, CASE event_type WHEN 'click' THEN 'prompt' WHEN 'view' THEN 'metric' WHEN 'error' THEN 'error' ELSE 'debug_log' END AS event_type, CASE event_type WHEN 'click' THEN 'user' ELSE 'runtime' END AS role, count(*) AS n, CAST(sum(event_id + 2) AS BIGINT) AS tokens FROM events GROUP BY ALL",
    ),
    "adapter_amp_threads": (
        amp_thread_rollup,
        "SELECT CAST(conv_id AS VARCHAR) AS thread_id, count(*) AS message_count, min(lpad(CAST(turn AS VARCHAR), 4, '0')) AS first_created_at, max(lpad(CAST(turn AS VARCHAR), 4, '0')) AS last_created_at, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id",
    ),
    "redaction_classes": (
        redaction_classes,
        "SELECT array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'bearer_token' END, CASE WHEN event_id % 3 = 0 THEN 'email' END, CASE WHEN event_id % 5 = 0 THEN 'secret_assignment' END], lambda x: x IS NOT NULL), ',') AS classes, event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 AS pii_redacted, count(*) AS n FROM events GROUP BY ALL",
    ),
}
