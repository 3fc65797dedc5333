"""Guard, rewrites, benchmark contracts, discovery and plans' shapes."""

import json

import pytest
from pyspark.sql import functions as F

from loomstone.plans import benchmark, compat, guard, questions, registry, views
from loomstone.plans.driver_tables import canonical_events
from loomstone.plans.envelope import Envelope
from loomstone.sources import discovery, history

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "sql, reason",
    [
        ("", "empty_statement"),
        (" ;; ", "empty_statement"),
        ("select 1; select 2", "multi_statement"),
        ("select 'drop' as x", "mutating_statement"),
        ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "mutating_statement"),
        ("show tables", "unsupported_statement"),
        ("explain  select 1", "unsupported_statement"),
        ("values (1)", "unsupported_statement"),
    ],
)
def test_refused(sql, reason):
    with pytest.raises(guard.Violation) as v:
        guard.check_text(sql)
    assert v.value.details["violation"]["reason"] == reason


@pytest.mark.parametrize("sql", ["select 1;", " SELECT 1 ", "with a as (select 1) select * from a", "EXPLAIN SELECT 1", "explain query plan select 1", "select dropped_count from t"])
def test_allowed(sql):
    guard.check_text(sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM other", "SELECT TRANSFORM(a) USING 'cat' FROM (SELECT 1 AS a)", "SELECT java_method('java.lang.Math','abs',-1)", "SELECT * FROM a JOIN (SELECT * FROM secret.t) USING (x)"])
def test_refused_by_plan(spark, sql):
    with pytest.raises(guard.Violation):
        guard.check_plan(spark, sql, ["a"])


def test_plan_of_own_relations(spark):
    guard.check_plan(spark, "WITH t AS (SELECT * FROM a), u AS (SELECT * FROM t) SELECT * FROM u JOIN A USING (x)", ["a"])


def test_profile():
    p = guard.profile("SELECT a FROM t\nWHERE b GROUP BY c LIMIT 3;")
    assert p["statement_kind"] == "select" and p["has_where"] and p["has_group_by"] and p["has_limit"] and not p["likely_full_scan"]
    assert guard.profile("select 1")["likely_full_scan"] and guard.profile("explain select 1")["uses_explain"]
    assert [guard.latency_bucket(n) for n in (250, 251, 1501, 10_001)] == ["fast", "moderate", "slow", "very_slow"]


def test_rewrites(spark):
    assert compat.numbered_parameters("a = ?1 AND b = ? AND c = '?2'") == "a = :p1 AND b = :p2 AND c = '?2'"
    sql = compat.rewritten("SELECT strftime('%Y-%m-%dT%H:00:00Z', ?1 / 1000, 'unixepoch') AS h, iif(1 < 2, 'a', 'b') AS i, strftime('%s', '1970-01-01T00:01:00Z') AS s, julianday('1970-01-01T12:00:00Z') AS j, 'iif(' AS lit")
    row = compat.run(spark, sql, [1770274803007]).first()
    assert (row.h, row.i, row.s, row.j, row.lit) == ("2026-02-05T07:00:00Z", "a", "60", 2440588.0, "iif(")


def test_parameters():
    assert compat.parameters('[1, "a", null, true]') == [1, "a", None, 1] and compat.parameters(None) == [] and compat.parameters("7") == [7]
    for bad in ("[[1]]", '{"a": 1}', "nope"):
        with pytest.raises(ValueError):
            compat.parameters(bad)


def test_benchmark_contracts(tmp_path):
    rows = [{"n": 3}, {"n": 2}, {"n": 2}]
    assert benchmark.order_problem(rows, "n_desc") is None and benchmark.order_problem(rows[:1], "zz") is None
    assert "not sorted" in benchmark.order_problem(rows, "n_asc") and "checked" in benchmark.order_problem(rows, "n") and "missing" in benchmark.order_problem(rows, "m_asc")
    reports = [{"domain": d, "passed": ok} for d, ok in [("a", True)] * 3 + [("a", False)] + [("b", True)] * 4]
    gate = benchmark.release_gate(benchmark.summarize(reports))
    assert not gate["passed"] and gate["failing_domains"] == ["a"] and len(gate["failed_checks"]) == 3
    good = benchmark.default_corpus()
    for change in ({"schema_version": "v0"}, {"questions": []}, {"questions": [good["questions"][0]] * 2}):
        path = tmp_path / "c.json"
        path.write_text(json.dumps(good | change))
        with pytest.raises(ValueError):
            benchmark.load_corpus(str(path))


def test_envelope():
    e = Envelope("query.sql", data={"rows": []}).warn("c", "m").as_dict()
    assert e["ok"] and e["warnings"] == [{"code": "c", "message": "m"}] and "error" not in e
    assert Envelope.failed("x", "code", "m", {"a": 1}).as_dict()["error"] == {"code": "code", "message": "m", "details": {"a": 1}}


def test_priorities():
    found = discovery.prioritized({"amp": 2})
    assert [s["adapter"] for s in found[:4]] == ["amp"] * 4 and found[0]["precedence"] == 10 and len(found) == 16
    assert [s["path"] for s in discovery.prioritized({}, ["codex"], ["jsonl"])] == ["~/.codex/history.jsonl"]
    assert {s["adapter"] for s in discovery.prioritized({}, path_parts=["GEMINI/t"])} == {"gemini"}


@pytest.mark.parametrize("path, want", [("~", "/h"), ("~/x/../y", "/h/y"), ("a/./b", "/w/a/b"), ("/z", "/z")])
def test_paths(path, want):
    assert discovery.absolute(path, "/h", "/w") == want


def test_bad_paths():
    for args in (("~u/x", "/h", "/w"), ("x", "h", "/w")):
        with pytest.raises(ValueError):
            discovery.absolute(*args)


def test_classified(spark):
    cases = [("a.bin", b"x\x00", "binary"), ("a.jsonl", b"", "jsonl"), ("a.JSON", b"zz", "json"), ("a.log", b"{}", "text_log"), ("a", b"\xff\xfe", "binary"), ("a", b'{"a":1}\n\n[2]\n', "jsonl"), ("a", b' {"a":\n1} ', "json"), ("a", b"hello", "text_log"), ("a", b"", "text_log"), ("b.jsonl", b"\x00", "binary")]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c, _) in enumerate(cases)], "i int, path string, content binary")
    got = {r.i: r.k for r in df.select("i", discovery.classified(F.col("path"), F.col("content")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


def test_shell_history(spark):
    lines = ["", ": 1:2;codex x", "claude", ": bad;ls ~/.claude/x", ": 1:2;", "opencode-cli", "  GEMINI "]
    found = history.commands(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert found.count() == 5 and found.filter("timestamp_unix = 1").first()["duration_seconds"] == 2
    assert [(r.adapter, r.score) for r in history.scores(found).collect()] == [("claude", 2), ("codex", 1), ("gemini", 1), ("amp", 0), ("opencode", 0)]


def test_questions_on_an_empty_mart(spark):
    events = canonical_events(spark, SF).limit(0)
    runs = spark.sql("SELECT * FROM (VALUES ('a','b','c',0L,0L)) AS t(ingest_run_id, started_at_utc, status, events_read, events_written)").limit(0)
    marks = spark.sql("SELECT * FROM (VALUES ('a','b','c','d','e')) AS t(source_key, source_kind, source_path, refreshed_at_utc, staleness_state)").limit(0)
    relations = {"agentlog_events": events, "ingest_runs": runs, "ingest_watermarks": marks} | {n: v(events) for n, v in views.VIEWS.items()}
    got = {i: [tuple(r) for r in q(relations).collect()] for i, q in questions.QUESTIONS.items()}
    assert got.pop("q-freshness-003") == got.pop("q-reliability-004") == [(0.0,)]
    assert got.pop("q-freshness-004") == [(0,)] and got.pop("q-reliability-003") == [(0, 0)]
    assert not any(got.values())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_stay_in_the_jvm(spark):
    plan = _plan(registry.queries()["q_usage_001"](spark, SF))
    assert "Python" not in plan and "CartesianProduct" not in plan and "TakeOrderedAndProject" in plan
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("value" not in line.split("ReadSchema")[1] for line in scans)
    assert "PushedFilters" in plan and _plan(registry.queries()["v_adapters"](spark, SF)).count("FileScan") == 1


def test_no_query_of_the_mart_runs_python(spark):
    for name, query in registry.queries().items():
        if name.startswith(("v_", "q_", "dedupe", "upsert", "source_", "parity", "stats")):
            assert "Python" not in _plan(query(spark, SF)), name
