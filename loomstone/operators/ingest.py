"""Ingest: upserts into the Parquet mart, the run ledger, source frontiers and staleness."""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstone import schema
from loomstone.operators import validate

#: Table names of the mart.
TABLES: dict[str, StructType] = {"agentlog_events": schema.EVENTS, "ingest_runs": schema.INGEST_RUNS, "ingest_watermarks": schema.INGEST_WATERMARKS, "agentlog_schema_meta": schema.SCHEMA_META}

#: Bad lines that a report names; all are counted.
LISTED = 1000


def utc_now() -> str:
    """Fixed-width RFC 3339 UTC, so that text order is time order."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """All of `old` with rows of `new` put over them by key; of several new rows the one with the largest `order` stays.

    A grouped aggregation with partial sums: a key with many versions is folded before the shuffle.
    """
    columns = old.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    both = old.select(whole.alias("w"), F.col(key).alias("k"), F.lit(-1).cast("long").alias("o")).unionByName(new.select(whole.alias("w"), F.col(key).alias("k"), F.col(order).cast("long").alias("o")))
    return both.groupBy("k").agg(F.max_by("w", "o").alias("w")).select("w.*")


def frontier(events: DataFrame, order: str) -> DataFrame:
    """Each source's latest row: by time, and of equal times the later in the input."""
    key = F.concat_ws("|", "source_kind", "source_path").alias("source_key")
    row = F.struct("source_kind", "source_path", "source_record_locator", "source_record_hash", F.col("timestamp_unix_ms").alias("last_event_timestamp_unix_ms"))
    return events.groupBy(key).agg(F.max_by(row, F.struct(F.col("timestamp_unix_ms"), F.col(order))).alias("r")).select("source_key", "r.*")


def decision() -> Column:
    """struct<decision, reason, before>: whether a source moved since its last frontier (columns with prev_)."""
    made = lambda d, reason, before: F.struct(F.lit(d).alias("decision"), F.lit(reason).alias("reason"), F.lit(before).alias("before"))
    now, then = F.col("last_event_timestamp_unix_ms"), F.col("prev_last_event_timestamp_unix_ms")
    same = F.col("source_record_locator").eqNullSafe(F.col("prev_source_record_locator")) & F.col("source_record_hash").eqNullSafe(F.col("prev_source_record_hash"))
    return (
        F.when(~F.col("known"), made("process", "no_prior_watermark", "stale"))
        .when(then.isNull(), made("process", "no_prior_timestamp", "stale"))
        .when(now > then, made("process", "advanced_timestamp", "stale"))
        .when(now < then, made("process", "regressed_timestamp", "stale"))
        .when(~same, made("process", "changed_marker", "stale"))
        .otherwise(made("skip", "unchanged_frontier", "fresh"))
    )


def watermarks(old: DataFrame, current: DataFrame, run_id: str, refreshed_at: str) -> DataFrame:
    """The watermark table after a refresh that saw the sources of `current` (a frontier).

    A source that was seen is fresh; one that wasn't is stale and keeps its other columns.
    """
    kept = ["source_kind", "source_path", "source_record_locator", "source_record_hash", "last_event_timestamp_unix_ms"]
    before = old.select("source_key", F.lit(True).alias("was"), *(F.col(c).alias(f"prev_{c}") for c in [*kept, "last_ingest_run_id", "refreshed_at_utc"]))
    now = current.withColumn("seen", F.lit(True))
    both = now.join(before, "source_key", "full_outer").withColumns({"known": F.coalesce("was", F.lit(False)), "seen": F.coalesce("seen", F.lit(False))})
    both = both.withColumn("d", decision())
    note = lambda seen, d, reason, state: F.concat(F.lit('{"decision_reason":"'), reason, F.lit('","incremental_decision":"'), d, F.lit(f'","observed_in_refresh":{seen},"pre_refresh_staleness_state":"'), state, F.lit('"}'))
    seen = F.col("seen")
    return both.select(
        "source_key",
        *(F.when(seen, F.col(c)).otherwise(F.col(f"prev_{c}")).alias(c) for c in kept),
        F.when(seen, F.lit(run_id)).otherwise(F.col("prev_last_ingest_run_id")).alias("last_ingest_run_id"),
        F.when(seen, F.lit(refreshed_at)).otherwise(F.col("prev_refreshed_at_utc")).alias("refreshed_at_utc"),
        F.when(seen, "fresh").otherwise("stale").alias("staleness_state"),
        F.when(seen, note("true", F.col("d.decision"), F.col("d.reason"), F.col("d.before"))).otherwise(note("false", F.lit("process"), F.lit("missing_in_latest_refresh"), F.lit("stale"))).alias("metadata_json"),
    )


def overall_staleness(seen: int, known: int, missing: int) -> str:
    return "unknown" if not seen and not known else "stale" if missing else "fresh"


class Mart:
    """The mart's tables as Parquet folders of numbered versions, of which the last is the table.

    A write goes beside the versions and becomes the next by one rename, so a reader, and a crash at any
    moment, finds the old table or the new one, whole. One writer at a time: a version that another
    writer has made meanwhile ends the write. The version before the last stays for readers that began
    on it. The store must rename folders in one step, as HDFS and local disks do.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path, store = self._path(f"{self.root}/{name}")
        if not store.exists(path):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in store.listStatus(path) if re.match(r"v\d+$", f.getPath().getName()))

    def latest(self) -> dict[str, int]:
        """The version of each table; 0 if there is none."""
        return {name: max(self._versions(name), default=0) for name in TABLES}

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:012d}"

    def ensure(self) -> None:
        """Make missing tables, and note the schema's version once."""
        for name, kind in TABLES.items():
            if not self._versions(name):
                self.replace(name, self.spark.createDataFrame([], kind))
        if not self.read("agentlog_schema_meta").filter(F.col("schema_version") == schema.SCHEMA_VERSION).limit(1).collect():
            row = self.spark.createDataFrame([(schema.SCHEMA_VERSION, utc_now())], schema.SCHEMA_META)
            self.replace("agentlog_schema_meta", self.read("agentlog_schema_meta").unionByName(row))

    def exists(self) -> bool:
        return bool(self._versions("agentlog_events"))

    def read(self, name: str) -> DataFrame:
        """The table as it stands now; later writes don't change what this frame reads."""
        versions = self._versions(name)
        if not versions:
            raise FileNotFoundError(f"no table {name} in the mart at {self.root}")
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name, versions[-1]))

    def replace(self, name: str, df: DataFrame) -> None:
        """Write the next version and make it the table by one rename."""
        before = self._versions(name)
        fresh, into = f"{self.root}/{name}/_new-{uuid.uuid4().hex}", self._folder(name, before[-1] + 1 if before else 1)
        df.select(*TABLES[name].fieldNames()).write.parquet(fresh)
        (new, store), (live, _) = self._path(fresh), self._path(into)
        if self._versions(name) != before or not store.rename(new, live):
            store.delete(new, True)
            raise RuntimeError(f"another writer has changed {name} meanwhile")
        for old in before[:-1]:
            store.delete(self._path(self._folder(name, old))[0], True)

    def put(self, name: str, row: dict) -> None:
        """Put one ledger row in the place of that with its key."""
        key = schema.PRIMARY_KEYS[name][0]
        one = self.spark.createDataFrame([tuple(row[c] for c in TABLES[name].fieldNames())], TABLES[name])
        self.replace(name, self.read(name).filter(F.col(key) != row[key]).unionByName(one))


def refresh(mart: Mart, lines: DataFrame, source_root: str, fail_fast: bool = False, run_id: str | None = None, listed: int = LISTED) -> dict:
    """Load numbered JSONL lines (line, value) into the mart; gives the report.

    Records that don't decode are warnings, or end the refresh before it leaves a trace if `fail_fast`.
    All of them are counted; the report lists the first `listed`. Rows are put over older ones by event
    id; old rows that the input lacks stay. A failure after the run began, of whichever table, is noted
    in the ledger. With the `run_id` of an earlier run, that run's ledger row is written anew.
    """
    started, clock = utc_now(), time.monotonic()
    run_id = run_id or f"ingest-{time.time_ns():016x}"
    decoded = validate.decode(lines).cache()
    try:
        n, skipped = decoded.agg(F.count_if(F.col("problem").isNull()), F.count("problem")).first()
        bad = decoded.filter("problem IS NOT NULL").select("line", "problem").orderBy("line").limit(1 if fail_fast else listed).collect() if skipped else []
        if bad and fail_fast:
            raise ValueError(f"failed to decode event at line {bad[0]['line']}: {bad[0]['problem']}")
        events = validate.events_of(decoded)
        mart.ensure()
        run = {"ingest_run_id": run_id, "started_at_utc": started, "finished_at_utc": None, "status": "running", "source_root": source_root, "events_read": n, "events_written": 0, "warnings_count": skipped, "errors_count": 0, "error_summary_json": "{}"}
        mart.put("ingest_runs", run)
        written = 0
        try:
            mart.replace("agentlog_events", upsert(mart.read("agentlog_events"), events, "event_id", "line"))
            written = n
            finished = utc_now()
            old = mart.read("ingest_watermarks")
            known = old.count()
            mart.replace("ingest_watermarks", watermarks(old, frontier(events, "line"), run_id, finished))
            counts = {r["staleness_state"]: r["count"] for r in mart.read("ingest_watermarks").groupBy("staleness_state").count().collect()}
            mart.put("ingest_runs", run | {"status": "success", "finished_at_utc": finished, "events_written": n})
        except Exception as error:
            mart.put("ingest_runs", run | {"status": "failed", "finished_at_utc": utc_now(), "events_written": written, "errors_count": 1, "error_summary_json": json.dumps({"message": str(error)[:2000]})})
            raise
        state = overall_staleness(counts.get("fresh", 0), known, counts.get("stale", 0))
    finally:
        decoded.unpersist()
    return {
        "schema_version": "agentlog.ingest_report.v1",
        "ingest_run_id": run_id,
        "source_root": source_root,
        "status": "success",
        "started_at_utc": started,
        "finished_at_utc": finished,
        "duration_ms": int((time.monotonic() - clock) * 1000),
        "counts": {"read": n, "inserted": n, "updated": 0, "skipped": skipped},
        "warnings": [f"line {r['line']}: {r['problem']}" for r in bad],
        "watermarks": {"sources_upserted": counts.get("fresh", 0), "staleness_state": state},
    }
