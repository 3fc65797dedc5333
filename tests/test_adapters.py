"""Adapters over made-up records: kinds, ids, text, times, warnings."""

import json

import pytest
from pyspark.sql import functions as F

from loomstone.plans import adapter_queries
from loomstone.sources import amp, claude, codex, gemini, opencode
from loomstone.sources.messages import join_parts
from loomstone.sources.records import Parsed, lines_of

T = "2026-02-01T10:00:00Z"


def _doc(spark, *rows, path="/x/a.jsonl"):
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)
    return spark.createDataFrame([(path, text)], "source_path string, value string")


def _kinds(parsed):
    return [(r.record_format, r.event_type, r.role) for r in parsed.events.orderBy("sequence_source").collect()]


def _warned(parsed):
    return [r.message for r in parsed.warnings.orderBy("position", "message").collect()]


def test_lines(spark):
    got = lines_of(_doc(spark, "a\r\nb\rc\n\nd")).orderBy("line").collect()
    assert [(r.line, r.value) for r in got] == [(1, "a"), (2, "b\rc"), (3, ""), (4, "d")]


def test_codex_rollout_kinds(spark):
    item = lambda kind, **p: {"type": "response_item", "timestamp": T, "payload": {"type": kind} | p}
    message = lambda kind, **p: {"type": "event_msg", "timestamp": T, "payload": {"type": kind} | p}
    plain = lambda kind: {"event_type": kind, "created_at": T, "text": "x"}
    parsed = codex.rollout(
        lines_of(
            _doc(
                spark,
                *[item("message", role=r, content=[{"text": "x"}]) for r in ("user", "assistant", "system", "developer")],
                item("function_call", call_id="c"),
                item("custom_tool_call_output", call_id="c", output={"content": "o"}),
                item("reasoning", summary=["s"]),
                item("other"),
                message("user_message", message="x"),
                message("token_count"),
                message("agent_message"),
                *[plain(k) for k in ("session_meta", "turn_context", "compacted", "user_prompt", "assistant_response", "tool_result", "event_msg.meta_x", "event_msg.status", "odd")],
            )
        )
    )
    M, R, N, C, O, S, D = ("message", "prompt", "user"), ("message", "response", "assistant"), ("system", "system_notice", "system"), ("tool_call", "tool_invocation", "tool"), ("tool_result", "tool_output", "tool"), ("system", "status_update", "runtime"), ("diagnostic", "debug_log", "runtime")
    NR = ("system", "system_notice", "runtime")
    assert _kinds(parsed) == [M, R, N, R, C, O, S, D, M, ("diagnostic", "metric", "runtime"), S, NR, S, NR, M, R, O, NR, S, D]
    assert [w for w in _warned(parsed) if "unrecognized" in w] == ["line 20: unrecognized `event_type` `odd`; mapped as diagnostic runtime event"]
    rows = {r.sequence_source: r for r in parsed.events.collect()}
    assert rows[5].tool_result_text == "o" and rows[5].content_text == "o" and rows[6].content_text == "s"


def test_codex_copies_share_a_hash(spark):
    a = codex.rollout(lines_of(_doc(spark, {"session_id": "s", "event_type": "user_prompt", "created_at": T, "text": "say  it"}, path="/1"))).events.first()
    b = codex.history(lines_of(_doc(spark, {"session_id": "s", "role": "user", "created_at": T, "content": " say it "}, path="/2"))).events.first()
    assert a.canonical_hash == b.canonical_hash and a.event_id != b.event_id


def test_codex_present_but_unusable_time(spark):
    row = codex.rollout(lines_of(_doc(spark, {"event_type": "user_prompt", "created_at": 5, "timestamp": T, "text": "x"}))).events.first()
    assert (row.timestamp_quality, row.timestamp_unix_ms, row.timestamp_utc) == ("fallback", 1, "1970-01-01T00:00:00.001Z")


def test_codex_log(spark):
    parsed = codex.diagnostics(lines_of(_doc(spark, f"{T} FATAL codex.desktop boot k=v session=s k=w", f"{T} odd sub ev", "too short")))
    rows = parsed.events.orderBy("sequence_source").collect()
    assert (rows[0].event_type, rows[0].session_id, json.loads(rows[0].tags_json)[2]) == ("error", "s", "desktop_diagnostic")
    assert json.loads(rows[0].metadata_json)["codex_log_fields"] == {"k": "w", "session": "s"}
    assert [w.split(":")[0] for w in _warned(parsed)] == ["line 2", "line 3"]


def test_claude_session_kinds(spark):
    rec = lambda **r: {"timestamp": T, "sessionId": "s", "cwd": "/p"} | r
    parsed = claude.sessions(
        lines_of(
            _doc(
                spark,
                rec(type="User", message={"role": "user", "content": "q"}),
                rec(type="assistant", message={"model": "m", "content": [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"z": 1, "a": 2}}]}),
                rec(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "o"}], "is_error": True}]}),
                rec(type="user", toolUseResult={"stdout": "so"}),
                rec(type="progress"),
                rec(type="file-history-snapshot", snapshot={"timestamp": T}),
                rec(type="summary", message={"role": "Assistant", "content": "z"}),
                rec(type="odd"),
            )
        )
    )
    assert [k[:2] for k in _kinds(parsed)] == [("message", "prompt"), ("tool_call", "tool_invocation"), ("tool_result", "tool_output"), ("tool_result", "tool_output"), ("system", "status_update"), ("system", "artifact_reference"), ("message", "response"), ("diagnostic", "debug_log")]
    rows = parsed.events.orderBy("sequence_source").collect()
    assert rows[1].tool_arguments_json == '{"a":2,"z":1}' and rows[1].event_id == "claude-call-t" and rows[1].model == "m"
    assert rows[2].flags_json == '["tool_error"]' and rows[2].content_text == "o" and rows[3].content_text == "so"
    assert rows[0].conversation_id == "/p" and rows[0].session_id == "s"


def test_claude_subagent_and_routing(spark):
    row = claude.sessions(lines_of(_doc(spark, {"subagent_session_id": "S", "role": "assistant", "created_at": T, "text": "x", "trace_id": "tr", "parentUuid": "pu"}))).events.first()
    assert (row.event_id, row.session_id, row.conversation_id, row.parent_event_id, row.flags_json) == ("tr", "S", None, "pu", '["subagent","delegated"]')
    assert [claude.shape_of(p) for p in ("/a/history.jsonl", "/a/x_mcp_cache.jsonl", "/a/b.TXT", "/a/s.jsonl")] == ["history", "mcp_log", "mcp_log", "sessions"]


def test_gemini(spark):
    chat = gemini.chats(_doc(spark, {"sessionId": "s", "model": "m", "messages": [{"role": "USER", "time": 1770274803, "parts": [{"text": "a"}, {"text": "b"}]}, {"author": "gemini", "timestamp": "bad", "toolCalls": [{"functionName": "f", "args": {"x": 1}}]}, {"role": "alien", "text": "t"}]}))
    rows = chat.events.orderBy("sequence_source").collect()
    assert [(r.record_format, r.content_text, r.timestamp_quality) for r in rows] == [("message", "a\nb", "exact"), ("tool_call", None, "fallback"), ("diagnostic", "t", "fallback")]
    meta = json.loads(rows[0].metadata_json)
    assert meta["gemini_session_id_source"] == "root" and meta["gemini_content_parts"] == 2 and rows[0].provider == "google"
    assert any("unknown role `alien`" in w for w in _warned(chat))
    log = gemini.logs(_doc(spark, [{"severity": "WARN", "message": "w"}, {"kind": "metric", "text": "m"}, "x"]))
    assert _kinds(log) == [("diagnostic", "status_update", "runtime"), ("diagnostic", "metric", "runtime")]
    assert "gemini chat payload must include `messages` array" in _warned(gemini.chats(_doc(spark, {"a": 1})))
    assert [gemini.shape_of(p) for p in ("/a/Logs.json", "/a/chats/x.json", "/a/session-1.json", "/a/z.json")] == ["logs", "chats", "chats", None]


def test_amp_file_changes(spark):
    one = amp.file_changes(_doc(spark, {"path": "f", "before": "b", "ts": T, "reverted": "true", "threadId": 7}, path="/h/.amp/file-changes/S-9/c"))
    row = one.events.first()
    assert (row.source_record_locator, row.content_text, row.content_mime, row.session_id, row.conversation_id) == ("json:root", "before:\nb", "text/plain", "S-9", "7")
    assert json.loads(row.metadata_json)["reverted"] is True
    assert _warned(amp.file_changes(_doc(spark, "3"))) == ["amp file-change event root must be an object or array of objects"]


def test_amp_first_present_key_decides(spark):
    row = amp.file_changes(_doc(spark, {"thread_id": {"x": 1}, "threadId": "t", "diff": "d", "timestamp": T})).events.first()
    assert row.conversation_id is None


def test_sums_of_times_beyond_a_long(spark, tmp_path):
    """40,000 events at the end of year 9999: their milliseconds sum to more than a long holds, and come out whole."""
    ms, n = 253402300799000, 40_000
    assert ms * n > 2**63
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_millis(F.lit(ms)).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = adapter_queries.amp_file_changes(spark, str(tmp_path)).collect()
    chars = sum(len(f"text of {i}") for i in range(n))
    assert [tuple(r) for r in found] == [("tool_result", "tool_output", "tool", "exact", n, ms * n, chars)]


@pytest.mark.parametrize("total, kind", [(2**63 - 1, "bigint"), (2**63, "decimal(38,0)"), (-(2**63), "bigint"), (-(2**63) - 1, "decimal(38,0)")])
def test_type_of_summed_times(spark, total, kind):
    half = total // 2
    rows = [("f", "t", "r", "exact", half, "ab"), ("f", "t", "r", "exact", total - half, None), ("f", "t", "r", "fallback", 1, None), ("f", "u", "r", "exact", None, None)]
    events = spark.createDataFrame(rows, "record_format string, event_type string, role string, timestamp_quality string, timestamp_unix_ms long, content_text string")
    found = adapter_queries._kinds(Parsed(events, events))
    assert dict(found.dtypes)["ms"] == kind
    assert {(r.event_type, r.timestamp_quality, r.n, r.ms, r.chars) for r in found.collect()} == {("t", "exact", 2, total, 2), ("t", "fallback", 1, 1, 0), ("u", "exact", 1, None, 0)}


def test_opencode(spark):
    found, info = opencode.session_messages(lines_of(_doc(spark, {"sessionID": "a", "messageID": "m2", "createdAt": "2", "role": "user"}, {"session_id": "a", "message_id": "m1", "role": "assistant"}, {"sessionID": "a", "title": "T"}, {"messageID": "lost"})))
    assert found.count() == 2 and info.first()["title"] == "T"
    roll = opencode.session_rollup(found).first()
    assert (roll.message_count, roll.first_created_at, roll.roles) == (2, "2", ["assistant", "user"])
    parts = opencode.parts(lines_of(_doc(spark, {"sessionID": "a", "messageID": "m1", "partID": "p2", "kind": "tool_step"}, {"sessionID": "a", "messageID": "m1", "partID": "p1", "text": "t"}, {"sessionID": "a", "messageID": "zz", "partID": "p3"}, {"sessionID": "a"})), found)
    assert {(r.part_id, r.is_orphan, r.is_step_event) for r in parts.collect()} == {("p2", False, True), ("p1", False, False), ("p3", True, False)}
    joined, orphans = opencode.joined(found, parts)
    assert [(r.message_id, [p.part_id for p in r.parts]) for r in joined.collect()] == [("m1", ["p1", "p2"]), ("m2", [])]
    assert [r.part_id for r in orphans.collect()] == ["p3"]


def test_join_gives_parts_to_the_first_of_equal_keys(spark):
    messages = spark.createDataFrame([("s", "m", i) for i in range(3)], "session_id string, message_id string, input_seq long")
    parts = spark.createDataFrame([("s", "m", "p")], "session_id string, message_id string, part_id string")
    joined, _ = join_parts(messages, parts)
    assert [len(r.parts) for r in joined.orderBy("input_seq").collect()] == [1, 0, 0]


def test_all_events_are_valid(spark):
    """What adapters emit passes the validator once it is written as JSONL."""
    from loomstone.operators import artifacts, validate

    say = {"session_id": "s", "event_type": "user_prompt", "created_at": T, "text": "x"}
    parsed = codex.rollout(lines_of(_doc(spark, say))) + gemini.logs(_doc(spark, [{"role": "user", "message": "m", "timestamp": T}])) + opencode.auxiliary_log(lines_of(_doc(spark, f"{T} INFO usage token_usage prompt=12 completion=19")))
    lines = artifacts.as_jsonl(parsed.events).select(F.monotonically_increasing_id().alias("line"), "value")
    report = validate.report(lines)
    assert report["errors"] == 0 and report["records_validated"] == 3
