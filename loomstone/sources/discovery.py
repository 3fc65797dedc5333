"""Where agents keep their logs: the path registry, priorities, classes of files."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (adapter, precedence, path, role, format, recursive).
REGISTRY = [
    ("codex", 10, "~/.codex/sessions", "session_store", "directory", True),
    ("codex", 20, "~/.codex/history.jsonl", "history_stream", "jsonl", False),
    ("codex", 30, "~/.codex/log", "runtime_diagnostics", "text_log", True),
    ("claude", 10, "~/.claude/projects", "session_store", "directory", True),
    ("claude", 20, "~/.claude/statsig", "runtime_diagnostics", "text_log", True),
    ("claude", 30, "~/.claude.json", "config_metadata", "json", False),
    ("gemini", 10, "~/.gemini/tmp", "session_store", "directory", True),
    ("gemini", 20, "~/.gemini/history", "history_stream", "directory", True),
    ("gemini", 30, "~/.gemini/debug", "runtime_diagnostics", "text_log", True),
    ("amp", 10, "~/.amp/sessions", "session_store", "directory", True),
    ("amp", 20, "~/.amp/history", "history_stream", "directory", True),
    ("amp", 30, "~/.amp/logs", "runtime_diagnostics", "text_log", True),
    ("amp", 40, "~/.amp/file-changes", "session_store", "directory", True),
    ("opencode", 10, "~/.opencode/project", "session_store", "directory", True),
    ("opencode", 20, "~/.opencode/sessions", "session_store", "directory", True),
    ("opencode", 30, "~/.opencode/logs", "runtime_diagnostics", "text_log", True),
]
FIELDS = ["adapter", "precedence", "path", "role", "format_hint", "recursive"]
#: Adapters that normalize reads.
SUPPORTED = ["codex", "claude", "gemini", "amp"]
# File endings by adapter, and those that a snapshot reads.
ENDINGS = {"codex": ["jsonl", "ndjson"], "claude": ["jsonl", "ndjson"]} | {a: ["json", "jsonl", "ndjson"] for a in ("gemini", "amp", "opencode")}
SNAPSHOT_ENDINGS = ["json", "jsonl", "ndjson", "pb"]
SAMPLE_BYTES = 256 * 1024


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "adapter string, precedence int, path string, role string, format_hint string, recursive boolean")


def prioritized(scores: dict[str, int], adapters: list[str] | None = None, formats: list[str] | None = None, path_parts: list[str] | None = None) -> list[dict]:
    """Registry rows that pass the filters, the most used adapter first, then by precedence, adapter and path; an empty filter passes all."""
    found = []
    for row in REGISTRY:
        source = dict(zip(FIELDS, row)) | {"history_score": scores.get(row[0], 0)}
        if adapters and source["adapter"] not in adapters or formats and source["format_hint"] not in formats:
            continue
        if path_parts and not any(p.lower() in source["path"].lower() for p in path_parts):
            continue
        found.append(source)
    return sorted(found, key=lambda s: (-s["history_score"], s["precedence"], s["adapter"], s["path"]))


def sources_artifact(found: list[dict]) -> dict:
    counts: dict[str, int] = {}
    for s in found:
        counts[s["adapter"]] = counts.get(s["adapter"], 0) + 1
    return {"total_sources": len(found), "adapter_counts": dict(sorted(counts.items())), "sources": [{k: s[k] for k in ("adapter", "path", "role", "format_hint", "recursive", "precedence", "history_score")} for s in found]}


def usage_artifact(scores: dict[str, int]) -> dict:
    usage = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return {"total_command_hits": sum(scores.values()), "adapter_usage": [{"adapter": a, "score": n} for a, n in usage]}


def resolved(path: str, home: str, root: str | None = None) -> str:
    """~ stands for the root if one is given, else for home; other relative paths join the root."""
    if path == "~" or path.startswith("~/"):
        return posixpath.join(root or home, path[2:]) if path != "~" else root or home
    return posixpath.join(root, path.lstrip("/")) if root and not posixpath.isabs(path) else path


def absolute(path: str, home: str, cwd: str) -> str:
    """An absolute path without . and ..; ~user is refused."""
    if path.startswith("~") and path != "~" and not path.startswith("~/"):
        raise ValueError(f"unsupported home reference: {path}")
    if not posixpath.isabs(home) or not posixpath.isabs(cwd):
        raise ValueError("home and working directory must be absolute")
    full = home if path == "~" else posixpath.join(home, path[2:]) if path.startswith("~/") else posixpath.join(cwd, path)
    return posixpath.normpath(full)


def files_below(path: str, recursive: bool = True) -> list[str]:
    """All files of a folder, sorted; a folder that can't be read is an error, a file is itself."""
    if os.path.isfile(path):
        return [path]
    found, failed = [], []
    for folder, folders, names in os.walk(path, onerror=failed.append):
        found += [os.path.join(folder, n) for n in names]
        if not recursive:
            folders.clear()
    if failed:
        raise failed[0]
    return sorted(found)


def wanted(path: str, adapter: str) -> bool:
    """Whether normalize reads a file of that adapter; Amp's file changes have any ending."""
    return adapter == "amp" and "/.amp/file-changes" in path or os.path.splitext(path)[1].lower().lstrip(".") in ENDINGS[adapter]


def classified(path: Column, content: Column, sample: int = SAMPLE_BYTES) -> Column:
    """jsonl, json, text_log or binary, from a file's name and first bytes.

    A NUL is binary; then the ending decides; then text that isn't UTF-8 is binary; then two first lines
    that look like JSON, then a text that does as a whole.
    """
    head = F.substring(content, 1, sample)
    text = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string"))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    shaped = lambda s: s.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    trim = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda s: s != "")
    two = (F.size(lines) >= 2) & shaped(F.get(lines, F.lit(0))) & shaped(F.get(lines, F.lit(1)))
    return (
        F.when(F.contains(head.cast("string"), F.lit("\x00")), "binary")
        .when(ending.isin("jsonl", "ndjson"), "jsonl")
        .when(ending == "json", "json")
        .when(ending.isin("log", "txt"), "text_log")
        .when(text.isNull(), "binary")
        .when(F.coalesce(two, F.lit(False)), "jsonl")
        .when(shaped(trim(text)), "json")
        .otherwise("text_log")
    )
