"""The commands in a row over a made-up home folder: exit codes, artifacts, envelopes."""

import json
import os

import pytest

from loomstone import cli


def _write(path, *rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("home"))
    say = {"session_id": "s1", "created_at": "2026-02-01T10:00:00Z"}
    _write(f"{root}/.codex/sessions/a.jsonl", say | {"event_id": "e1", "event_type": "user_prompt", "text": "list files"}, say | {"event_type": "x", "text": "odd"}, "broken {")
    _write(
        f"{root}/.codex/sessions/sub/b.jsonl",
        {"type": "response_item", "timestamp": "2026-02-01T10:00:01Z", "payload": {"type": "function_call", "call_id": "c1", "name": "shell", "arguments": "{}"}},
        {"type": "response_item", "timestamp": "2026-02-01T10:00:04Z", "payload": {"type": "function_call_output", "call_id": "c1", "output": "a.txt"}},
    )
    _write(f"{root}/.codex/history.jsonl", {"session_id": "s1", "prompt_id": "p1", "role": "user", "content": "list   files", "created_at": "2026-02-01T10:00:00Z"})
    _write(f"{root}/.claude/projects/p/session.jsonl", {"project_id": "p", "session_id": "s2", "kind": "user", "created_at": "2026-02-01T11:00:00Z", "text": "mail me at a@b.io"})
    _write(f"{root}/.gemini/tmp/x/chats/session-1.json", json.dumps({"conversation_id": "g", "messages": [{"role": "user", "timestamp": "2026-02-01T12:00:00Z", "content": "hi"}]}))
    _write(f"{root}/.amp/file-changes/T-1/c1", json.dumps({"uri": "f", "diff": "+x", "timestamp": "2026-02-01T13:00:00Z"}))
    _write(f"{root}/.zsh_history", ": 1700000000:0;claude --resume", "codex exec", "claude")
    return root


def _run(spark, capsys, home, *argv):
    code = cli.main(["--home-dir", home, "--cwd", home, "--out-dir", f"{home}/out", *argv], spark)
    return code, capsys.readouterr()


def test_workflow(spark, capsys, home):
    code, out = _run(spark, capsys, home, "normalize")
    assert code == 0, out
    events = [json.loads(line) for line in open(f"{home}/out/events.jsonl")]
    assert [e["sequence_global"] for e in events] == list(range(len(events)))
    # The history's copy of the prompt is the same talk at the same time, so it folds into one event.
    folded = [e for e in events if e["metadata"]["dedupe_count"] == 2]
    assert len(folded) == 1 and sorted(folded[0]["metadata"]["dedupe_members"]) == ["e1", "p1"]
    assert len(folded[0]["metadata"]["provenance_entries"]) == 2
    stats = json.load(open(f"{home}/out/stats.json"))
    assert stats["counts"]["duplicates_removed"] == 1 and stats["adapter_contributions"]["opencode"] == 0
    assert json.load(open(f"{home}/out/discovery/zsh_history_usage.json"))["adapter_usage"][0] == {"adapter": "claude", "score": 2}
    assert "adapter=codex status=success" in out.out and "adapter=opencode status=skipped reason=adapter_not_supported_by_normalize_v1" in out.out

    code, out = _run(spark, capsys, home, "validate", f"{home}/out/events.jsonl")
    assert code == 0, out
    assert json.load(open(f"{home}/out/validate/report.json"))["errors"] == 0

    code, out = _run(spark, capsys, home, "ingest", "refresh")
    first = json.loads(out.out)
    assert code == 0 and first["ok"] and first["data"]["counts"]["read"] == len(events)
    assert first["data"]["watermarks"]["staleness_state"] == "fresh"
    code, out = _run(spark, capsys, home, "ingest", "refresh")
    assert json.loads(out.out)["ok"]

    code, out = _run(spark, capsys, home, "query", "sql", "SELECT count(*) AS n, max(iif(tool_name = 'shell', 1, 0)) AS s FROM agentlog_events WHERE adapter_name = ?1", "--params", '["codex"]')
    envelope = json.loads(out.out)
    assert code == 0 and envelope["data"]["rows"] == [{"n": 4, "s": 1}], envelope
    code, out = _run(spark, capsys, home, "query", "sql", "SELECT duration_ms FROM v_tool_calls WHERE pairing_status = 'paired'")
    assert json.loads(out.out)["data"]["rows"] == [{"duration_ms": 3000}]
    code, out = _run(spark, capsys, home, "query", "sql", "SELECT event_id FROM agentlog_events ORDER BY 1", "--row-cap", "2")
    assert json.loads(out.out)["meta"]["truncated"] is True and len(json.loads(out.out)["data"]["rows"]) == 2
    for sql in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT replace('a','b','c')", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System','exit',0)", ""):
        code, out = _run(spark, capsys, home, "query", "sql", sql)
        assert code == 1 and json.loads(out.out)["error"]["code"] == "sql_guardrail_violation", sql
    code, out = _run(spark, capsys, home, "query", "sql", "SELECT nope FROM agentlog_events")
    assert code == 1 and json.loads(out.out)["error"]["code"] == "query_execution_failed"

    code, out = _run(spark, capsys, home, "query", "schema")
    shown = json.loads(out.out)
    assert shown["meta"]["table_count"] == 3 and shown["meta"]["view_count"] == 4
    assert [c["name"] for c in shown["data"]["tables"][0]["columns"]][:3] == ["schema_version", "event_id", "run_id"]
    code, out = _run(spark, capsys, home, "query", "catalog", "--verbose")
    assert json.loads(out.out)["meta"]["concept_count"] == 4

    code, out = _run(spark, capsys, home, "query", "benchmark")
    report = json.loads(out.out)
    assert code == 0 and report["meta"]["passed_count"] == 16 and report["meta"]["release_gate_passed"], report
    assert os.path.exists(f"{home}/out/benchmarks/answerability_report.json")

    code, out = _run(spark, capsys, home, "snapshot")
    assert code == 0, out
    samples = open(f"{home}/out/snapshot/samples.jsonl").read()
    assert "a@b.io" not in samples and "[REDACTED]" in samples

    code, out = _run(spark, capsys, home, "inspect", f"{home}/out/events.jsonl", "--json")
    body = out.out.split("\n", 1)[1].rsplit("loomstone: completed", 1)[0]
    shown = json.loads(body)
    assert shown["classification"] == "jsonl" and shown["normalized_event_summary"]["normalized_rows"] == len(events)
    assert shown["line_counts"]["total_lines"] == len(events)


def test_exit_codes(spark, capsys, home, tmp_path):
    assert _run(spark, capsys, home, "no-such-command")[0] == 64
    assert _run(spark, capsys, home, "inspect", "/no/such/file")[0] == 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n')
    assert _run(spark, capsys, home, "validate", str(bad))[0] == 2
    empty = str(tmp_path / "empty")
    code = cli.main(["--home-dir", home, "--out-dir", empty, "ingest", "refresh"], spark)
    assert code == 1 and json.loads(capsys.readouterr().out)["error"]["code"] == "ingest_events_missing"
    code = cli.main(["--home-dir", home, "--out-dir", empty, "query", "sql", "SELECT 1"], spark)
    assert code == 1 and json.loads(capsys.readouterr().out)["error"]["code"] == "query_mart_unavailable"
