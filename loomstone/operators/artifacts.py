"""Files that the commands leave: JSONL events, JSON reports, the snapshot's parts."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.operators import snapshot
from loomstone.sources import discovery
from loomstone.sources.records import json_lines, lines_of, read_documents, variants


def write_json(path: str, value: object) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def as_jsonl(events: DataFrame) -> DataFrame:
    """(sequence_global, value): each event as one JSON object; nulls and empty lists and metadata are left out."""
    fields = []
    for f in schema.JSONL_EVENTS:
        mart = f.name if f.name in schema.EVENT_COLUMNS else f"{f.name}_json"
        if f.name in schema.LIST_COLUMNS:
            items = F.from_json(mart, "array<string>")
            fields.append(F.when((F.col(mart) != "[]") & (F.size(items) > 0), items).alias(f.name))
        elif f.name == "metadata":
            fields.append(F.when(F.col(mart) != "{}", F.try_parse_json(mart)).alias(f.name))
        elif f.name == "pii_redacted":
            fields.append(F.col(mart).cast("boolean").alias(f.name))
        else:
            fields.append(F.col(mart).alias(f.name))
    return events.select("sequence_global", F.to_json(F.struct(*fields)).alias("value"))


def write_events(path: str, events: DataFrame) -> int:
    """One JSONL file in the events' order, streamed partition by partition to the driver's disk."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for row in as_jsonl(events).orderBy("sequence_global").select("value").toLocalIterator():
            f.write(row["value"] + "\n")
            n += 1
    return n


def snapshot_records(documents: DataFrame) -> DataFrame:
    """(source_path, source_record_locator, record, warning) of raw files, by their endings.

    JSON lines give line:n; an object's messages give messages:n, an array's items index:n, other JSON is
    root; protobuf files are named and sized only.
    """
    ending = F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    lines = json_lines(lines_of(documents.filter(ending.isin("jsonl", "ndjson"))))
    bad = F.when(F.col("v").isNull(), F.col("problem"))
    from_lines = lines.select("source_path", F.concat(F.lit("line:"), F.col("line").cast("string")).alias("source_record_locator"), F.when(F.col("v").isNotNull(), F.to_json("v")).alias("record"), bad.alias("warning"))
    rooted = documents.filter(ending == "json").withColumn("root", F.try_parse_json("value"))
    listed = variants(F.col("root"), "$.messages")
    items = variants(F.col("root"), "$")
    label = F.when(listed.isNotNull(), "messages").when(items.isNotNull(), "index").otherwise("root")
    each = rooted.select("source_path", label.alias("label"), F.posexplode(F.coalesce(listed, items, F.array("root"))).alias("at", "v"))
    locator = F.when(F.col("label") == "root", "root").otherwise(F.concat(F.col("label"), F.lit(":"), (F.col("at") + 1).cast("string")))
    broken = F.when(F.col("v").isNull(), F.concat(F.lit("invalid JSON document: "), "source_path"))
    from_documents = each.select("source_path", locator.alias("source_record_locator"), F.to_json("v").alias("record"), broken.alias("warning"))
    return from_lines.unionByName(from_documents)


def protobuf_records(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    if not paths:
        return None
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:(//)?", "").alias("source_path"), "length")
    name = F.regexp_extract("source_path", "([^/]+)$", 1)
    record = F.to_json(F.struct(F.lit("protobuf_metadata").alias("artifact_kind"), F.col("length").alias("byte_size"), name.alias("file_name")))
    return raw.select("source_path", F.lit("protobuf:metadata").alias("source_record_locator"), record.alias("record"), F.lit("protobuf is not decoded").alias("warning"))


def _sources(home: str, root: str | None) -> Iterator[tuple[dict, list[str]]]:
    for source in discovery.prioritized({}):
        path = discovery.resolved(source["path"], home, root)
        if os.path.exists(path):
            files = [f for f in discovery.files_below(path, source["recursive"]) if os.path.splitext(f)[1].lower().lstrip(".") in discovery.SNAPSHOT_ENDINGS]
            if files:
                yield source, files


def take_snapshot(spark: SparkSession, home: str, root: str | None, out_dir: str, sample_size: int = snapshot.SAMPLE_SIZE) -> dict:
    """Profile and sample all discovered files; writes index, samples and schema profile, and checks them against each other."""
    adapter_of: dict[str, str] = {}
    text, binary = [], []
    for source, files in _sources(home, root):
        for f in files:
            if f not in adapter_of:
                adapter_of[f] = source["adapter"]
                (binary if f.endswith(".pb") else text).append(f)
    records = None
    if text:
        records = snapshot_records(read_documents(spark, text))
    if (more := protobuf_records(spark, binary)) is not None:
        records = more if records is None else records.unionByName(more)
    folder = os.path.join(out_dir, "snapshot")
    if records is None:
        index, sampled, profiles, warnings = [], [], [], []
    else:
        named = spark.createDataFrame(sorted(adapter_of.items()), "source_path string, source_kind string")
        records = records.join(F.broadcast(named), "source_path").cache()
        warnings = [r["warning"] for r in records.filter("warning IS NOT NULL").select("warning").orderBy("warning").collect()]
        sound = records.filter("record IS NOT NULL")
        index = [r.asDict() for r in sound.groupBy("source_kind", "source_path").agg(F.count("*").alias("records")).orderBy("source_kind", "source_path").collect()]
        chosen = snapshot.samples(sound.select("source_kind", "source_path", "source_record_locator", "record"), sample_size)
        chosen = chosen.withColumn("record", snapshot.sanitized(F.col("record"))).orderBy("source_kind", "source_path", "sample_rank")
        sampled = [r.asDict() | {"record": json.loads(r["record"])} for r in chosen.collect()]
        profiles = [r.asDict(recursive=True) for r in snapshot.source_profiles(sound.select(F.concat_ws("|", "source_kind", "source_path").alias("source"), F.col("record").alias("value"))).orderBy("source").collect()]
        records.unpersist()
    wrong = snapshot.integrity(index, sampled, profiles)
    if wrong:
        raise ValueError("snapshot parts disagree: " + "; ".join(wrong))
    write_json(os.path.join(folder, "index.json"), {"sources": index, "warnings": warnings})
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "samples.jsonl"), "w", encoding="utf-8") as f:
        for s in sampled:
            f.write(json.dumps(s, ensure_ascii=False, sort_keys=True) + "\n")
    write_json(os.path.join(folder, "schema_profile.json"), {"profiles": profiles})
    with open(os.path.join(folder, "samples.jsonl"), encoding="utf-8") as f:  # what was written must read back
        if [json.loads(line) for line in f] != sampled:
            raise ValueError("samples don't read back as written")
    return {"sources": len(index), "samples": len(sampled), "warnings": warnings}
