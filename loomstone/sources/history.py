"""Shell history: commands of a zsh history file, and how often each adapter is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone import schema

# The first word of a command and the parts of one that tell of an adapter.
SIGNS = {
    "codex": ("codex", [".codex/", "/.codex", "codex-cli"]),
    "claude": ("claude", [".claude/", "/.claude", "claude-code"]),
    "gemini": ("gemini", [".gemini/", "/.gemini"]),
    "amp": ("amp", [".amp/", "/.amp"]),
    "opencode": ("opencode", [".opencode/", "/.opencode"]),
}


def commands(lines: DataFrame) -> DataFrame:
    """(timestamp_unix, duration_seconds, command) of history lines (value); extended or bare, empty ones left out."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    extended = line.rlike("^: [^;]*;")
    head = F.regexp_extract(line, "^: ([^;]*);", 1)
    body = F.when(extended, F.regexp_replace(F.regexp_replace(line, "(?s)^: [^;]*;", ""), r"(?U)^\s+|\s+$", "")).otherwise(line)
    part = lambda i: F.when(extended, F.try_element_at(F.split(head, ":"), F.lit(i)))
    seconds = F.trim(part(2)).try_cast("long")
    rows = lines.select(F.trim(part(1)).try_cast("long").alias("timestamp_unix"), F.when(seconds >= 0, seconds).alias("duration_seconds"), body.alias("command"))
    return rows.filter("command <> ''")


def scores(found: DataFrame) -> DataFrame:
    """(adapter, score): commands that use each adapter, most first; adapters without any keep 0."""
    low = F.lower("command")
    first = F.split(F.regexp_replace(low, r"(?U)^\s+", ""), r"(?U)\s+")[0]

    def uses(adapter: str):
        name, parts = SIGNS[adapter]
        hit = first == name
        for p in parts:
            hit = hit | low.contains(p)
        return hit

    counts = found.agg(*(F.count_if(uses(a)).alias(a) for a in schema.ADAPTERS))
    return counts.unpivot([], schema.ADAPTERS, "adapter", "score").orderBy(F.desc("score"), "adapter")
