"""Operators on canonical events: pairing, rollups, folding, order, validation, ingest, parity, sampling."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstone import schema, scratch
from loomstone.operators import artifacts, ingest, normalize, parity, snapshot, validate
from loomstone.plans import adapter_queries, views
from loomstone.sources import orchestrate, records

BASE = dict.fromkeys(schema.EVENT_COLUMNS) | {
    "schema_version": "agentlog.v1",
    "run_id": "run-a",
    "sequence_global": 0,
    "source_kind": "codex",
    "adapter_name": "codex",
    "source_path": "/p",
    "source_record_locator": "line:1",
    "record_format": "message",
    "event_type": "prompt",
    "role": "user",
    "timestamp_utc": "1970-01-01T00:00:01.000Z",
    "timestamp_unix_ms": 1000,
    "timestamp_quality": "exact",
    "tags_json": "[]",
    "flags_json": "[]",
    "warnings_json": "[]",
    "errors_json": "[]",
    "raw_hash": "r",
    "canonical_hash": "c",
    "metadata_json": "{}",
}


def events(spark, *rows):
    full = [BASE | {"event_id": f"e{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in schema.EVENT_COLUMNS) for r in full], schema.EVENTS)


def call(ms, call_id, tool="shell", **more):
    return {"record_format": "tool_call", "event_type": "tool_invocation", "role": "tool", "timestamp_unix_ms": ms, "tool_call_id": call_id, "tool_name": tool, "session_id": "session-1"} | more


def result(ms, call_id, tool="shell", **more):
    return call(ms, call_id, tool) | {"record_format": "tool_result", "event_type": "tool_output"} | more


def test_schema():
    assert len(schema.EVENT_COLUMNS) == 44 and schema.EVENT_COLUMNS[0] == "schema_version" and schema.EVENT_COLUMNS[-1] == "metadata_json"
    document = schema.json_schema()
    assert document["additionalProperties"] is False and "tags" in document["properties"] and "tags" not in document["required"]


def test_pairing(spark):
    found = views.tool_calls(
        events(
            spark,
            {"timestamp_unix_ms": 1000, "session_id": "session-1"},
            {"timestamp_unix_ms": 1010, "session_id": "session-1", "event_type": "response", "role": "assistant"},
            call(1100, "tc-1"),
            result(1250, "tc-1"),
            call(1300, "tc-2", "grep"),
            result(1400, "tc-3", "ls"),
            {"timestamp_unix_ms": 1410, "session_id": "session-1", "event_type": "error", "record_format": "diagnostic", "role": "runtime"},
            {"timestamp_unix_ms": 2000, "session_id": "session-2"},
        )
    )
    got = {r["tool_call_id"]: (r["pairing_status"], r["duration_ms"], r["duration_source"], r["duration_quality"]) for r in found.collect()}
    assert got == {"tc-1": ("paired", 150, "paired", "medium"), "tc-2": ("missing_result", None, None, None), "tc-3": ("orphan_result", None, None, None)}


def test_pairing_corners(spark):
    found = views.tool_calls(
        events(
            spark,
            call(100, "a"),
            call(110, "a"),
            result(150, "a", None),
            result(160, "a"),
            call(200, "b", None),
            result(190, "b"),
            result(250, "b"),
            call(300, ""),
            result(310, ""),
            result(320, None),
        )
    ).collect()
    by = sorted(("~" if r["tool_call_id"] is None else r["tool_call_id"], r["call_event_id"] or "-", r["result_event_id"] or "-", r["pairing_status"]) for r in found)
    assert by == [
        ("", "e7", "-", "missing_result"),
        ("a", "e0", "e2", "paired"),
        ("a", "e1", "e2", "paired"),
        ("b", "e4", "e5", "invalid_order"),
        ("~", "-", "e9", "orphan_result"),
    ]


def test_sessions(spark):
    rows = [{"timestamp_unix_ms": 1000, "session_id": "s"}, {"timestamp_unix_ms": 1010, "session_id": "s", "event_type": "response"}, call(1100, "t1", session_id="s"), result(1250, "t1", session_id="s"), call(1300, "t2", "grep", session_id="s"), result(1400, "t3", "ls", session_id="s"), {"timestamp_unix_ms": 1410, "session_id": "s", "event_type": "error"}, {"session_id": ""}, {"session_id": None}]
    r = views.sessions(events(spark, *rows)).collect()
    assert len(r) == 1
    assert (r[0].event_count, r[0].first_event_timestamp_unix_ms, r[0].last_event_timestamp_unix_ms, r[0].duration_ms, r[0].tool_call_count, r[0].tool_result_count, r[0].prompt_count, r[0].response_count, r[0].error_count, r[0].distinct_tool_count) == (7, 1000, 1410, 410, 2, 2, 1, 1, 1, 3)


def test_empty_mart(spark):
    none = events(spark).limit(0)
    assert all(v(none).count() == 0 for v in views.VIEWS.values())


def _seq(df):
    return df.withColumn("input_seq", F.substring("event_id", 2, 9).cast("long"))


def test_dedupe_prefers_exact(spark):
    df = _seq(events(spark, {"canonical_hash": "h", "timestamp_quality": "fallback", "source_record_locator": "line:1"}, {"canonical_hash": "h", "source_record_locator": "line:2"}, {"canonical_hash": "k"}))
    got = {r["canonical_hash"]: r for r in normalize.dedupe_and_order(df).collect()}
    meta = json.loads(got["h"]["metadata_json"])
    assert got["h"]["event_id"] == "e1" and meta["dedupe_count"] == 2 and meta["dedupe_members"] == ["e0", "e1"]
    assert [p["source_record_locator"] for p in meta["provenance_entries"]] == ["line:1", "line:2"]
    assert json.loads(got["k"]["metadata_json"])["dedupe_count"] == 1


def test_dedupe_fallbacks(spark):
    blank = {"canonical_hash": " "}
    df = _seq(events(spark, blank | {"content_text": "a  b"}, blank | {"content_text": " a b "}, blank | {"content_text": "a c"}, blank, blank, blank | {"source_record_locator": "line:2"}))
    got = normalize.dedupe(df)
    assert sorted((r["dedupe_strategy"], r["dedupe_count"]) for r in got.collect()) == [("fallback_a", 1), ("fallback_a", 2), ("fallback_b", 1), ("fallback_b", 2)]


def test_order_is_total_and_stable(spark):
    rng = random.Random(1)
    rows = [{"timestamp_unix_ms": rng.randrange(3), "timestamp_quality": rng.choice(schema.TIMESTAMP_QUALITIES), "sequence_source": rng.choice([None, 1, 2]), "source_record_locator": f"line:{rng.randrange(12)}", "canonical_hash": str(i)} for i in range(60)]
    df = events(spark, *rows)
    rank = {q: i for i, q in enumerate(schema.TIMESTAMP_QUALITIES)}
    want = [r["event_id"] for r in sorted(df.collect(), key=lambda r: (r.timestamp_unix_ms, rank[r.timestamp_quality], r.source_kind, r.source_path, r.source_record_locator, r.sequence_source is None, r.sequence_source or 0, r.canonical_hash, r.event_id))]
    for shuffled in (df, df.repartition(7), df.orderBy(F.desc("event_id"))):
        for order in (normalize.total_order, lambda d: normalize.total_order_at_scale(spark, d)):
            got = [r["event_id"] for r in order(shuffled).orderBy("sequence_global").collect()]
            assert got == want


def test_stats_are_zero_filled(spark):
    report = normalize.stats(events(spark, {"warnings_json": '["w","x"]'}), 3)
    assert report["counts"] == {"input_records": 3, "records_emitted": 1, "duplicates_removed": 2, "warnings": 2, "errors": 0}
    assert report["record_format_counts"] == {"message": 1, "tool_call": 0, "tool_result": 0, "system": 0, "diagnostic": 0}


def _lines(spark, *rows):
    return spark.createDataFrame([(i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "line long, value string")


def _record(**more):
    keep = {k: v for k, v in BASE.items() if v is not None and not k.endswith("_json")} | {"event_id": "e", "content_text": "t"}
    return keep | more


def test_validate_kinds(spark):
    report = validate.report(_lines(spark, _record(), "nope", "[1]", {"a": 1}, _record(extra=1), _record(role="alien"), _record(timestamp_unix_ms=-1), _record(source_kind="open_code", adapter_name="open_code"), _record(session_id=None), _record(tags=[1]), _record(cost_usd="x")))
    kinds = [(i["line"], i["kind"]) for i in report["issues"]]
    assert kinds == [(2, "invalid_json"), (3, "schema_violation"), (4, "schema_violation"), (5, "schema_violation"), (6, "schema_violation"), (7, "schema_violation"), (10, "schema_violation"), (11, "schema_violation")]
    assert report["records_validated"] == 3 and report["status"] == "fail" and report["interpreted_exit_code"] == 2
    assert report["per_agent_summary"]["opencode"]["records_validated"] == 1 and report["per_agent_summary"]["unknown"]["errors"] == 8


def test_validate_invariants(spark):
    bad = _record(timestamp_unix_ms=5, raw_hash=" ", canonical_hash="", content_text="")
    report = validate.report(_lines(spark, bad), "baseline")
    assert [(i["severity"], i["detail"]) for i in report["issues"]] == [
        ("error", "canonical_hash must be non-empty"),
        ("warning", "content_text is empty for user/assistant message record"),
        ("warning", "content_text null-rate 1.00 exceeds 0.40 threshold"),
        ("error", "raw_hash must be non-empty"),
        ("error", "timestamp mismatch: timestamp_utc=1000, timestamp_unix_ms=5"),
    ]
    strict = validate.report(_lines(spark, *[_record(event_id=str(i)) for i in range(3)], _record(content_text="")), "strict")
    assert [i["severity"] for i in strict["issues"]] == ["error", "error"]


def test_scorecard():
    assert validate.scorecard(2, 2, 2, 2, 1, 1, 0, 1) == {"overall_score": 79, "coverage_score": 100, "parse_success_score": 100, "content_completeness_score": 50, "timestamp_quality_score": 65, "weakest_dimensions": ["content_completeness", "timestamp_quality"]}
    assert validate.scorecard(0, 0, 0, 0, 0, 0, 0, 0)["overall_score"] == 100


def test_jsonl_round_trip(spark):
    df = events(spark, {"warnings_json": '["w"]', "pii_redacted": 1, "metadata_json": '{"a":{"b":[1]}}', "content_text": "é"})
    row = artifacts.as_jsonl(df).first()["value"]
    decoded = validate.decode(_lines(spark, row))
    assert decoded.first()["problem"] is None
    back = validate.events_of(decoded).drop("line")
    assert parity.differences(df, back).count() == 0


def test_refresh_staleness_and_upsert(spark, tmp_path):
    mart = ingest.Mart(spark, str(tmp_path / "mart"))
    first = ingest.refresh(mart, _lines(spark, _record(event_id="a", source_path="/x"), _record(event_id="b", source_path="/y"), "junk"), "/src")
    assert first["counts"] == {"read": 2, "inserted": 2, "updated": 0, "skipped": 1} and first["watermarks"]["staleness_state"] == "fresh"
    later = _record(event_id="a", source_path="/x", timestamp_unix_ms=2000, timestamp_utc="1970-01-01T00:00:02Z", content_text="one")
    second = ingest.refresh(mart, _lines(spark, later, later | {"content_text": "two"}), "/src")
    assert second["watermarks"] == {"sources_upserted": 1, "staleness_state": "stale"}
    kept = {r["event_id"]: r["content_text"] for r in mart.read("agentlog_events").collect()}
    assert kept == {"a": "two", "b": "t"}
    marks = {r["source_path"]: (r["staleness_state"], json.loads(r["metadata_json"])["decision_reason"]) for r in mart.read("ingest_watermarks").collect()}
    assert marks == {"/x": ("fresh", "advanced_timestamp"), "/y": ("stale", "missing_in_latest_refresh")}
    assert [r["status"] for r in mart.read("ingest_runs").collect()] == ["success", "success"]
    assert mart.read("agentlog_schema_meta").count() == 1
    with pytest.raises(ValueError):
        ingest.refresh(mart, _lines(spark, "junk"), "/src", fail_fast=True)
    assert mart.read("ingest_runs").count() == 2


def test_mart_versions(spark, tmp_path):
    """A write is one rename: what a reader holds stays readable, and what a crash leaves is no table."""
    mart = ingest.Mart(spark, str(tmp_path / "mart"))
    assert not mart.exists()
    mart.ensure()
    before = mart.read("agentlog_schema_meta")
    mart.replace("agentlog_schema_meta", before.unionByName(before))
    assert before.count() == 1 and mart.read("agentlog_schema_meta").count() == 2
    (tmp_path / "mart" / "agentlog_schema_meta" / "_new-left-by-a-crash").mkdir()
    assert mart.read("agentlog_schema_meta").count() == 2 and mart.latest()["ingest_runs"] == 1

    class Overtaken(ingest.Mart):
        def _path(self, text):
            if "_new-" in text:
                (tmp_path / "mart" / "ingest_runs" / "v000000000009").mkdir(exist_ok=True)
            return super()._path(text)

    with pytest.raises(RuntimeError, match="another writer"):
        Overtaken(spark, mart.root).replace("ingest_runs", mart.read("ingest_runs"))


def test_failures_of_any_table_are_in_the_ledger(spark, tmp_path):
    class Broken(ingest.Mart):
        def replace(self, name, df):
            if name == broken and df.sparkSession and self.latest()[name]:
                raise OSError(f"{name} can't be written")
            super().replace(name, df)

    for n, broken in enumerate(["agentlog_events", "ingest_watermarks"]):
        mart = Broken(spark, str(tmp_path / f"mart{n}"))
        with pytest.raises(OSError):
            ingest.refresh(mart, _lines(spark, _record(event_id="a")), "/src")
        (run,) = mart.read("ingest_runs").collect()
        assert (run["status"], run["errors_count"], run["events_written"]) == ("failed", 1, n) and broken in run["error_summary_json"]


def test_refresh_counts_all_and_lists_some(spark, tmp_path):
    report = ingest.refresh(ingest.Mart(spark, str(tmp_path / "mart")), _lines(spark, "junk", _record(event_id="a"), "{", "[]"), "/src", run_id="again", listed=2)
    assert report["counts"]["skipped"] == 3 and [w.split(":")[0] for w in report["warnings"]] == ["line 1", "line 3"] and report["ingest_run_id"] == "again"


def test_frontier_tie_takes_later_row(spark):
    df = _seq(events(spark, {"source_record_locator": "line:9"}, {"source_record_locator": "line:1"}))
    assert ingest.frontier(df, "input_seq").first()["source_record_locator"] == "line:1"


def test_parity(spark):
    left = events(spark, {}, {}, {"cost_usd": 1.0})
    right = events(spark, {}, {"tool_name": "x"}, {"cost_usd": 1.0 + 1e-16}, {}).filter("event_id <> 'e0'")
    got = [(r["event_id"], r["field"]) for r in parity.differences(left, right).orderBy("event_id", "field").collect()]
    assert got == [("e0", "missing_right"), ("e1", "tool_name"), ("e3", "missing_left")]


def _plain_sample(kinds, most):
    n = len(kinds)
    if n <= most:
        return list(range(n))
    chosen = set()
    first = {}
    for i, k in enumerate(kinds):
        if k is not None:
            first.setdefault(k, i)
    spaced = [0] if most == 1 else [(s * (n - 1) + (most - 1) // 2) // (most - 1) for s in range(most)]
    for i in [first[k] for k in sorted(first)] + spaced + list(range(n)):
        if len(chosen) < most:
            chosen.add(i)
    return sorted(chosen)


def test_sampling(spark):
    rng = random.Random(2)
    for trial in range(8):
        n, most = rng.randrange(1, 15), rng.randrange(1, 6)
        kinds = [rng.choice([None, None, "a", "b", "c"]) for _ in range(n)]
        df = spark.createDataFrame([("g", i, k) for i, k in enumerate(kinds)], "g string, i long, event_kind string").repartition(3)
        got = snapshot.sampled(df, ["g"], ["i"], most).orderBy("sample_rank").collect()
        assert [r["i"] for r in got] == _plain_sample(kinds, most), (kinds, most)
        assert [r["sample_rank"] for r in got] == list(range(len(got)))


def test_profile(spark):
    rows = [{"a": {"b": 1}, "c": [1, "x", None]}, {"a": None, "kind": " k "}]
    df = spark.createDataFrame([("s", json.dumps(r)) for r in rows] + [("s", "bad")], "source string, value string")
    got = {(r["path"], r["value_type"]): r["occurrences"] for r in snapshot.key_profile(df).collect()}
    assert got == {("a", "object"): 1, ("a", "null"): 1, ("a.b", "number"): 1, ("c", "array"): 1, ("c[]", "number"): 1, ("c[]", "string"): 1, ("c[]", "null"): 1, ("kind", "string"): 1}
    profile = snapshot.source_profiles(df.filter("value <> 'bad'")).first()
    assert profile["total_records"] == 2 and profile["event_kind_frequency"] == {"k": 1}


def test_sanitized_marks(spark):
    big = json.dumps({"mail": "me@site.org", "text": ["x" * 200] * 40})
    got = json.loads(spark.createDataFrame([(big,)], "r string").select(snapshot.sanitized(F.col("r")).alias("y")).first()["y"])
    assert got["sanitization_reason"] == "max_record_chars_exceeded" and got["snapshot_sanitized"] and got["redaction_classes"] == ["email"] and got["pii_redacted"]


def test_input_order_follows_paths_and_not_sizes(spark, tmp_path):
    for name, lines in (("a", 2), ("b", 900), ("c", 40)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(lines)))
    read = records.lines_of(records.read_documents(spark, [str(tmp_path / f"{n}.jsonl") for n in "cab"]))
    rows = orchestrate.placed(read.select(F.lit("codex").alias("adapter_name"), "source_path", "line")).orderBy("input_seq").collect()
    assert [(r.source_path[-7:], r.line) for r in rows] == [(f"{n}.jsonl", i) for n, k in (("a", 2), ("b", 900), ("c", 40)) for i in range(1, k + 2)]  # what follows the last line feed is a line too


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_a_record_is_parsed_once_and_the_pattern_agrees_with_the_look_key_by_key(spark):
    plan = validate.events_of(validate.decode(_lines(spark, "{}"))).select("event_id", "role")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # a filter on the problem, pushed below, parsed and judged a record again for each of its keys
    sound = json.loads(artifacts.as_jsonl(events(spark, {"content_text": "t", "tags_json": '["x"]', "metadata_json": '{"a":{"b":[{"c":[1]}]}}'})).first()["value"])
    odd = [
        {"cost_usd": 1}, {"cost_usd": 1.5}, {"cost_usd": 1e300}, {"cost_usd": "1"}, {"cost_usd": None}, {"model": None}, {"model": 5}, {"tags": []}, {"tags": None}, {"tags": [None]}, {"tags": [1]}, {"tags": [["x"]]},
        {"role": "boss"}, {"role": None}, {"source_kind": "open_code"}, {"sequence_source": -1}, {"sequence_source": 1.5}, {"sequence_global": None}, {"input_tokens": 10**19}, {"pii_redacted": 1}, {"pii_redacted": True},
        {"metadata": {}}, {"metadata": None}, {"metadata": []}, {"metadata": {"x>, model: STRING": 1, "y`": 2}}, {"metadata": {}, "model": ["x"]}, {"metadata": {"a": [[[[[[1]]]]]]}}, {"zzz": 1}, {"a b": 1}, {"": 1},
    ]
    lines = [json.dumps(sound | x) for x in odd] + [json.dumps({k: v for k, v in sound.items() if k != left}) for left in sound] + ["{", "[1]", "{}", "null", '"x"', "7", json.dumps(sound)]
    v = F.try_parse_json("value")
    judged = _lines(spark, *lines).select("line", validate._sound(v).alias("fast"), F.transform(F.array(F.struct("value", v.alias("v"))), lambda r: validate._problem(r["value"], r["v"]))[0].alias("slow")).collect()
    assert [r for r in judged if r["fast"] and r["slow"]] == [] and [lines[r["line"] - 1] for r in judged if not r["fast"] and not r["slow"]] == [json.dumps(sound | {"metadata": {"x>, model: STRING": 1, "y`": 2}}), json.dumps(sound | {"metadata": {"a": [[[[[[1]]]]]]}})]
    assert {r["line"]: r["problem"] for r in validate.decode(_lines(spark, *lines)).collect()} == {r["line"]: r["slow"] for r in judged}


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    """Files are read in blocks that no task must hold together; numbers, health and warnings are as over whole files."""
    folder = tmp_path / ".codex" / "sessions"
    folder.mkdir(parents=True)
    said = lambda i: json.dumps({"event_type": "odd" if i % 4 == 0 else "user_prompt", "created_at": "2024-01-01T00:00:00Z", "text": f"é{i}"}, ensure_ascii=False)
    (folder / "a b+c.jsonl").write_bytes("\n".join(said(i) + "\r" * (i % 2) if i % 5 else "" for i in range(1, 201)).encode())
    (folder / "d.jsonl").write_bytes(b"\n\n" + said(1007).encode() + b"\n{\n" + "x\ry z\n".encode())
    (folder / "_e.jsonl").write_bytes(said(1009).encode())
    (folder / "f.jsonl").write_bytes(b"")
    paths = [str(p) for p in sorted(folder.iterdir())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    listed, orchestrate.LISTED = orchestrate.LISTED, 3
    try:
        lines = records.read_lines(spark, paths)
        assert spark.read.text(paths[1], lineSep="\n").rdd.getNumPartitions() > 10
        got = sorted(tuple(r) for r in lines.select("source_path", "line", "value").filter("value <> ''").collect())
        assert got == sorted(tuple(r) for r in records.lines_of(records.read_documents(spark, paths)).filter("value <> ''").collect())
        blocks, records.BLOCKS = records.BLOCKS, 0
        try:
            assert sorted(tuple(r) for r in records.read_lines(spark, paths).select("source_path", "line", "value").filter("value <> ''").collect()) == got
        finally:
            records.BLOCKS = blocks
        events, warnings, health, n = orchestrate.parse_sources(spark, str(tmp_path), adapters=["codex"])
        assert n == events.count() == 162 and health["codex"]["events_emitted"] == 162 and health["codex"]["status"] == "success"
        assert health["codex"]["warnings_count"] == warnings.count() == 42 and len(health["codex"]["warnings"]) == 3
        ordered = orchestrate.normalize_sources(spark, str(tmp_path), adapters=["codex"])[0]
        assert sorted(ordered.select("source_record_locator").filter("source_path LIKE '%a b+c%'").collect()) == sorted((f"line:{i}",) for i in range(1, 201) if i % 5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        orchestrate.LISTED = listed


def test_events_alone_with_their_keys_are_folded_without_a_shuffle_of_rows(spark):
    def seen(df):
        names = sorted(df.columns)
        return sorted(tuple(map(str, r)) for r in df.select(*names).collect())

    rows = [{"event_id": f"e{i % 7}", "canonical_hash": f"c{i}" if i % 3 else "same" if i % 2 else "", "source_record_locator": f"line:{i}", "raw_hash": f"r{i}"} for i in range(30)]
    for some in (rows, rows[1:3], rows[:1] * 2):
        table = scratch.written(spark, orchestrate.placed(events(spark, *some), F.col("source_record_locator")))
        assert seen(normalize.dedupe_at_scale(table)) == seen(normalize.dedupe(table))
        shared, normalize.SHARED = normalize.SHARED, 0
        try:
            assert seen(normalize.dedupe_at_scale(table)) == seen(normalize.dedupe(table))
        finally:
            normalize.SHARED = shared


def test_times_of_normalize_beyond_a_long(spark):
    kinds = adapter_queries.whole_ms(spark, spark.sql("SELECT 'k' AS kind, 2L AS n, CAST(9223372036854775807 AS DECIMAL(38,0)) * 2 AS ms").select("kind", "n", F.col("ms").cast("decimal(38,0)").alias("ms")))
    assert dict(kinds.dtypes)["ms"] == "decimal(38,0)" and kinds.first()["ms"] == (2**63 - 1) * 2
