"""Snapshot: key profiles of JSON records, representative samples, redaction of samples."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import redact
from loomstone.functions.jsontext import first_string

RECORD_CHARS = 4096
SAMPLE_SIZE = 3


def event_kind(variant: Column) -> Column:
    """The first of event_type, kind and type that is a string and not blank."""
    return first_string(variant, "event_type", "kind", "type")


def _type_name(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def paths_of(value: object) -> Iterator[tuple[str, str]]:
    """(path, type) of every node below the root; a.b for members, a[] for items."""
    todo = [("", value)]
    while todo:
        path, x = todo.pop()
        if path:
            yield path, _type_name(x)
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{path}[]", v) for v in x]


def key_profile(records: DataFrame) -> DataFrame:
    """(source, path, value_type, occurrences) of JSON text records (source, value).

    Trees have any depth, so they are walked in Python; each batch sends its own counts, which the
    grouped sum folds before and after the shuffle.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for source, text in zip(frame["source"], frame["value"]):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                for path, kind in paths_of(value):
                    seen[source, path, kind] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "path", "value_type", "occurrences"])

    parts = records.select("source", "value").mapInPandas(count, "source string, path string, value_type string, occurrences long")
    return parts.groupBy("source", "path", "value_type").agg(F.sum("occurrences").alias("occurrences"))


def source_profiles(records: DataFrame) -> DataFrame:
    """A row for each source: records, key_stats map<path, struct<occurrences, value_types>>, kinds map<kind, n>."""
    keys = key_profile(records).groupBy("source", "path").agg(F.sum("occurrences").alias("occurrences"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("value_type", "occurrences")))).alias("value_types"))
    stats = keys.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("occurrences", "value_types"))), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))).alias("key_stats"))
    kinds = records.select("source", event_kind(F.try_parse_json("value")).alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))
    named = kinds.groupBy("source").agg(F.sum("n").alias("total_records"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))).alias("event_kind_frequency"))
    return named.join(stats, "source", "left")


def sampled(rows: DataFrame, keys: list[str], order: list[str], most: int = SAMPLE_SIZE) -> DataFrame:
    """At most `most` rows of each group with their sample_rank, as the group's order has them.

    First the first row of each event_kind, by kind; then rows at even spaces over the group, ends
    included; then from the start. All three are one ranking, so the choice is two windows and no
    more than the group's own rows meet in a task.
    """
    if most <= 0:
        return rows.limit(0).withColumn("sample_rank", F.lit(0))
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*order)
    placed = rows.withColumn("__i", F.row_number().over(ordered) - 1).withColumn("__n", F.count("*").over(group))
    placed = placed.withColumn("__first", (F.row_number().over(Window.partitionBy(*keys, "event_kind").orderBy("__i")) == 1) & F.col("event_kind").isNotNull())
    slots = most - 1
    spaced = F.array(F.lit(0).cast("long")) if not slots else F.transform(F.sequence(F.lit(0), F.lit(slots)), lambda s: F.floor((s * (F.col("__n") - 1) + slots // 2) / slots))
    step = F.array_position(spaced, F.col("__i").cast("long"))
    stage = F.when(F.col("__first"), 0).when(step > 0, 1).otherwise(2)
    rank = F.row_number().over(group.orderBy("__stage", F.when(F.col("__stage") == 0, F.col("event_kind")), F.when(F.col("__stage") == 1, F.col("__step")), "__i"))
    chosen = placed.withColumn("__step", step).withColumn("__stage", stage).withColumn("__rank", rank).filter(F.col("__rank") <= most)
    return chosen.withColumn("sample_rank", F.row_number().over(group.orderBy("__i")) - 1).drop("__i", "__n", "__first", "__step", "__stage", "__rank")


def sanitized(record: Column, limit: int = redact.LIMIT, most: int = RECORD_CHARS) -> Column:
    """JSON text of a record redacted, kept within a size, and marked for what was done to it."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                value, classes, cut = redact.redact_value(json.loads(text), limit)
            except (TypeError, ValueError):
                out.append(None)
                continue
            plain = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            large = len(plain) > most
            if large:
                room = max(32, most - 64)
                value = {"sanitization_reason": "max_record_chars_exceeded", "original_char_count": len(plain), "sanitized_preview": plain[: room - 3] + "..."}
            if isinstance(value, dict):
                value |= {"pii_redacted": True} if classes else {}
                value |= {"snapshot_truncated": True} if cut or large else {}
                value |= {"snapshot_sanitized": True} if large else {}
                value |= {"redaction_classes": sorted(classes)} if classes else {}
            out.append(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return of(record)


def samples(records: DataFrame, most: int = SAMPLE_SIZE) -> DataFrame:
    """Representative records (source_kind, source_path, source_record_locator, record as JSON text) with rank and kind."""
    kinded = records.withColumn("event_kind", event_kind(F.try_parse_json("record")))
    return sampled(kinded, ["source_kind", "source_path"], ["source_record_locator", "record"], most)


def integrity(index: list[dict], sampled_rows: list[dict], profiles: list[dict]) -> list[str]:
    """What doesn't fit between the parts of a snapshot: counts, ranks, order."""
    wrong = []
    if len({(r["source_kind"], r["source_path"]) for r in index}) != len(index):
        wrong.append("a source is listed twice")
    known = {(r["source_kind"], r["source_path"]): r.get("records", 0) for r in index}
    ranks: dict[tuple, list[int]] = {}
    for r in sampled_rows:
        ranks.setdefault((r["source_kind"], r["source_path"]), []).append(r["sample_rank"])
    for source, got in ranks.items():
        if got != list(range(len(got))):
            wrong.append(f"sample ranks of {source} are not 0, 1, ..")
        if source not in known:
            wrong.append(f"samples of {source} that isn't listed")
        elif len(got) > known[source]:
            wrong.append(f"{source} has more samples than records")
    if [(r["source_kind"], r["source_path"], r["sample_rank"]) for r in sampled_rows] != sorted((r["source_kind"], r["source_path"], r["sample_rank"]) for r in sampled_rows):
        wrong.append("samples are not in order")
    if sum(known.values()) != sum(p["total_records"] for p in profiles):
        wrong.append("profiles count other records than the index")
    return wrong
