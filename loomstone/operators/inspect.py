"""Inspect one file: its class, lines, JSON shape, and normalized events if it holds any."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.sources.discovery import classified
from loomstone.sources.records import lines_of, read_documents

SAMPLE_BYTES = 4096


def inspect(spark: SparkSession, path: str) -> dict:
    """The report; a path that isn't a file is an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"inspect target does not exist: {path}")
    if not os.path.isfile(path):
        raise IsADirectoryError(f"inspect target must be a file: {path}")
    raw = spark.read.format("binaryFile").load(path)
    size, kind = raw.select("length", classified(F.col("path"), F.col("content"), SAMPLE_BYTES)).first()
    report: dict = {"target_path": path, "file_size_bytes": size, "classification": kind, "line_counts": None, "json_document": None, "normalized_event_summary": None, "warnings": []}
    if kind == "json":
        v = F.try_parse_json("value")
        shape, keys, length = read_documents(spark, [path]).select(F.schema_of_variant(v), F.json_object_keys("value"), F.size(F.try_variant_get(v, "$", "array<variant>"))).first()
        if shape is None:
            raise ValueError("json source is not valid JSON")
        names = {"OBJECT": "object", "ARRAY": "array", "VOID": "null", "BOOLEAN": "bool", "STRING": "string"}
        root = next((n for k, n in names.items() if shape.startswith(k)), "number")
        report["json_document"] = {"root_type": root, "object_keys": sorted(keys or []) if root == "object" else [], "array_length": length if root == "array" else None}
    if kind not in ("jsonl", "text_log"):
        return report
    body = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    lines = lines_of(read_documents(spark, [path]))
    n, tail_empty = lines.agg(F.max("line"), F.max_by(F.col("value") == "", "line")).first() or (0, False)
    total = (n or 0) - (1 if tail_empty else 0)  # a line feed at the end starts no line
    rows = lines.withColumn("body", body).filter("body <> ''").withColumn("v", F.try_parse_json("body"))
    event = F.coalesce((F.try_variant_get("v", "$.schema_version", "string") == schema.SCHEMA_VERSION) & (F.trim(F.try_variant_get("v", "$.event_id", "string")) != ""), F.lit(False)) & F.schema_of_variant("v").startswith("OBJECT")
    filled, sound, events = rows.agg(F.count("*"), F.count("v"), F.count_if(event)).first()
    text = kind == "text_log"
    report["line_counts"] = {"total_lines": total, "non_empty_lines": filled, "json_rows": 0 if text else sound, "invalid_json_rows": 0 if text else filled - sound}
    if text:
        return report
    report["warnings"] = [f"line {r['line']}: invalid JSON" for r in rows.filter("v IS NULL").select("line").orderBy("line").collect()]
    if events:
        found = rows.filter(event).select(*(F.coalesce(F.try_variant_get("v", f"$.{c}", "string"), F.lit("unknown")).alias(c) for c in ("adapter_name", "event_type")))
        count = lambda c: {r[c]: r["count"] for r in found.groupBy(c).count().orderBy(c).collect()}
        report["normalized_event_summary"] = {"normalized_rows": events, "adapter_counts": count("adapter_name"), "event_type_counts": count("event_type")}
    return report


def rendered(report: dict) -> str:
    """The report as lines of text."""
    out = [f"{k}: {report[k]}" for k in ("target_path", "file_size_bytes", "classification")]
    for part in ("line_counts", "json_document", "normalized_event_summary"):
        for k, v in (report[part] or {}).items():
            if v is None or v == [] or v == {}:
                continue
            shown = ",".join(f"{a}={b}" for a, b in v.items()) if isinstance(v, dict) else ",".join(v) if isinstance(v, list) else v
            out.append(f"{part}.{k}: {shown}")
    return "\n".join(out + (["warnings:", *(f"- {w}" for w in report["warnings"])] if report["warnings"] else []))
