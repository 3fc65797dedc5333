"""Streams: files that arrive are put into the mart; hourly activity with a watermark."""

import json

from pyspark.sql import functions as F

from loomstone import schema
from loomstone.operators import ingest
from loomstone.streaming import refresh


def _record(i, ms, **more):
    stamp = f"1970-01-01T{ms // 3_600_000:02d}:00:00.000Z"
    return {"schema_version": "agentlog.v1", "event_id": f"e{i}", "run_id": "r", "sequence_global": i, "source_kind": "codex", "source_path": "/p", "source_record_locator": f"line:{i}", "adapter_name": "codex", "record_format": "tool_call", "event_type": "tool_invocation", "role": "tool", "timestamp_utc": stamp, "timestamp_unix_ms": ms, "timestamp_quality": "exact", "raw_hash": "a", "canonical_hash": str(i)} | more


def _put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_refresh_stream(spark, tmp_path):
    mart = ingest.Mart(spark, str(tmp_path / "mart"))
    folder = tmp_path / "in"
    _put(folder, "a.jsonl", _record(1, 0), _record(2, 0))

    def run():
        query = refresh.refresh_stream(mart, refresh.incoming_lines(spark, str(folder)), "/src").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert mart.read("agentlog_events").count() == 2
    _put(folder, "b.jsonl", _record(2, 3_600_000, tool_name="later"), _record(3, 0))
    run()
    run()  # nothing new arrives
    rows = {r["event_id"]: r["tool_name"] for r in mart.read("agentlog_events").collect()}
    assert rows == {"e1": None, "e2": "later", "e3": None}
    assert mart.read("ingest_runs").count() == 2


def test_hourly_activity(spark, tmp_path):
    folder = tmp_path / "in"
    _put(folder, "a.jsonl", *[_record(i, h * 3_600_000) for i, h in enumerate((0, 0, 1, 5))], {"junk": 1})
    events = refresh.typed_events(refresh.incoming_lines(spark, str(folder)))
    assert events.columns == schema.EVENT_COLUMNS
    query = refresh.hourly_activity(events).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start()
    query.awaitTermination(120)
    got = spark.table("hourly").select(F.hour("hour.start").alias("h"), "events", "tool_calls").orderBy("h").collect()
    assert [tuple(r) for r in got] == [(0, 2, 2), (1, 1, 1), (5, 1, 1)]
