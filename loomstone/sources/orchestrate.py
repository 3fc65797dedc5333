"""From prioritised sources on disk to canonical events, with the health of each adapter."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.operators import normalize
from loomstone.sources import amp, claude, codex, discovery, gemini
from loomstone.sources.records import Parsed, read_documents, read_lines

#: Parsers of lines, which are read in blocks of a file, and of whole documents.
_OF_LINES = {
    ("codex", "rollout"): codex.rollout,
    ("codex", "history"): codex.history,
    ("claude", "sessions"): claude.sessions,
    ("claude", "history"): claude.history,
    ("claude", "mcp_log"): claude.mcp_log,
}
_OF_DOCUMENTS = {
    ("gemini", "logs"): gemini.logs,
    ("gemini", "chats"): gemini.chats,
    ("amp", "file_changes"): amp.file_changes,
}


#: Warnings that an adapter's health lists; all are counted, and the table of warnings has them all.
LISTED = 10_000


@dataclass
class Health:
    supported: bool = True
    sources_considered: int = 0
    files_discovered: int = 0
    files_parsed: int = 0
    events_emitted: int = 0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings_count: int = 0

    def report(self) -> dict:
        """Status and its reason, then the counts."""
        if not self.supported:
            status, reason = "skipped", "adapter_not_supported_by_normalize_v1"
        elif not self.sources_considered:
            status, reason = "skipped", "no_discovered_sources"
        elif not self.errors:
            status, reason = "success", None
        elif self.events_emitted:
            status, reason = "partial_failure", "adapter_emitted_partial_results"
        else:
            status, reason = "failed", "adapter_failed_without_emitting_events"
        return {"status": status, "reason": reason, "sources_considered": self.sources_considered, "files_discovered": self.files_discovered, "files_parsed": self.files_parsed, "events_emitted": self.events_emitted, "warnings_count": self.warnings_count, "warnings": self.warnings, "errors": self.errors}


def shape_of(adapter: str, role: str, path: str) -> str | None:
    """The parser for a file, or None if normalize doesn't read it."""
    if adapter == "codex":
        return "history" if role == "history_stream" else "rollout"
    if adapter == "claude":
        return claude.shape_of(path)
    if adapter == "gemini":
        return gemini.shape_of(path)
    if adapter == "amp" and ("/file-changes/" in path or path.endswith("/file-changes")):
        return "file_changes"
    return None


def placed(events: DataFrame, place: Column | None = None) -> DataFrame:
    """`events` with input_seq, its place in the input: adapter, file by path, then place in the file.

    Scans take the largest file first, so a number of rows alone would follow sizes; within a file that
    one task reads from its start, which is meant if no `place` is given, it follows the lines.
    """
    return events.withColumn("input_seq", F.struct("adapter_name", "source_path", (F.monotonically_increasing_id() if place is None else place).alias("place")))


def _parsed(spark: SparkSession, key: tuple[str, str], paths: list[str]) -> Parsed:
    return _OF_LINES[key](read_lines(spark, paths)) if key in _OF_LINES else _OF_DOCUMENTS[key](read_documents(spark, paths))


def normalize_sources(spark: SparkSession, home: str, root: str | None = None, history: dict[str, int] | None = None, adapters: list[str] | None = None, fail_fast: bool = False) -> tuple[DataFrame, DataFrame, dict[str, dict], int]:
    """(events, warnings, health by adapter, records before folding)."""
    events, warnings, health, n = parse_sources(spark, home, root, history, adapters, fail_fast)
    return normalize.dedupe_and_order(placed(events, F.col("sequence_source"))) if n else events, warnings, health, n


def parse_sources(spark: SparkSession, home: str, root: str | None = None, history: dict[str, int] | None = None, adapters: list[str] | None = None, fail_fast: bool = False) -> tuple[DataFrame, DataFrame, dict[str, dict], int]:
    """(events as parsed, warnings, health by adapter, events), without folding and order.

    Files of one adapter and shape are one scan and one plan, however many they are; each record is parsed once. A file that
    can't be read as its shape is an error of its adapter, and ends the run if `fail_fast`.
    """
    health = {a: Health(supported=a in discovery.SUPPORTED) for a in (adapters or schema.ADAPTERS)}
    files: dict[tuple[str, str], list[str]] = {}
    for source in discovery.prioritized(history or {}, adapters):
        mine = health[source["adapter"]]
        if not mine.supported or source["format_hint"] not in ("directory", "jsonl"):
            continue
        path = discovery.resolved(source["path"], home, root)
        if not os.path.exists(path):
            continue
        mine.sources_considered += 1
        try:
            listed = discovery.files_below(path, source["recursive"])
        except OSError as error:
            mine.errors.append(f"{path}: {error}")
            if fail_fast:
                raise
            continue
        found = [f for f in listed if os.path.isfile(path) or discovery.wanted(f, source["adapter"])]
        mine.files_discovered += len(found)
        for f in found:
            shape = shape_of(source["adapter"], source["role"], f)
            if shape is None:
                mine.warnings.append(f"adapter `{source['adapter']}` skipped unsupported source file shape in normalize orchestrator: {f}")
                mine.files_parsed += 1
                continue
            if not os.access(f, os.R_OK):
                mine.errors.append(f"{f}: permission denied")
                if fail_fast:
                    raise PermissionError(f)
                continue
            files.setdefault((source["adapter"], shape), []).append(f)
            mine.files_parsed += 1
    parsed = {key: _parsed(spark, key, paths).written(spark) for key, paths in sorted(files.items())}
    if not parsed:
        empty = spark.createDataFrame([], schema.EVENTS)
        return empty, spark.createDataFrame([], "source_path string, position long, message string"), {a: h.report() for a, h in health.items()}, 0
    everything = reduce(Parsed.__add__, parsed.values())
    for row in everything.events.groupBy("adapter_name").count().collect():
        health[row["adapter_name"]].events_emitted = row["count"]
    order, failed = ["source_path", "position", "message"], []
    for adapter in sorted({a for a, _ in parsed}):
        mine = health[adapter]
        told = reduce(DataFrame.unionByName, [p.warnings for (a, _), p in parsed.items() if a == adapter])
        wrong = [f"{r['source_path']}: {r['message']}" for r in told.filter("position = 0").orderBy(*order).collect()]  # one a file
        mine.errors += wrong
        failed += wrong
        notes = told.filter("position <> 0")
        mine.warnings_count = len(mine.warnings) + notes.count()
        mine.warnings += [f"{r['source_path']}: {r['message']}" for r in notes.orderBy(*order).limit(LISTED).collect()]
    if fail_fast and failed:
        raise ValueError(min(failed))
    return everything.events, everything.warnings, {a: h.report() for a, h in health.items()}, sum(h.events_emitted for h in health.values())
