"""Raw records and how they become canonical events: what all adapters share."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone import schema, scratch
from loomstone.functions.jsontext import block_text, json_at, text_of
from loomstone.functions.text import digest, excerpt
from loomstone.functions.timeparse import format_ms, parse_ms

ADAPTER_VERSION = "v1"
RUN_ID = "normalize-orchestrator-v1"
#: Blocks of files whose places are broadcast; of more, lines are joined by a shuffle.
BLOCKS = 50_000
_WHITE = r"(?U)^\s+|\s+$"


@dataclass
class Parsed:
    """Events in the mart's columns, and warnings (source_path, position, message).

    `records`, where it is given, has both of each record, so that they can be written in one pass: the event's
    columns, position, problem and notes.
    """

    events: DataFrame
    warnings: DataFrame
    records: DataFrame | None = None

    @staticmethod
    def of(records: DataFrame) -> Parsed:
        warnings = records.select("source_path", "position", F.explode("notes").alias("message"))
        return Parsed(records.filter("problem IS NULL").select(*schema.EVENT_COLUMNS), warnings, records)

    def written(self, spark: SparkSession) -> Parsed:
        """The same out of a table, so that no record is parsed twice."""
        return Parsed(scratch.written(spark, self.events), self.warnings) if self.records is None else Parsed.of(scratch.written(spark, self.records))

    def __add__(self, other: Parsed) -> Parsed:
        return Parsed(self.events.unionByName(other.events), self.warnings.unionByName(other.warnings))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, value): each file as one row.

    Spark's listing leaves out files whose names begin with a dot or an underscore; the few that are
    asked for by such a name are read by the driver.
    """
    hidden = [p for p in paths if p.rsplit("/", 1)[-1][:1] in (".", "_")]
    shown = [p for p in paths if p not in set(hidden)]
    found = None
    if shown:
        found = spark.read.text(shown, wholetext=True).select(_path().alias("source_path"), "value")
    if hidden:
        texts = []
        for p in hidden:
            with open(p, encoding="utf-8", errors="replace", newline="") as f:
                texts.append((p, f.read()))
        own = spark.createDataFrame(texts, "source_path string, value string")
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "source_path string, value string") if found is None else found


def _path() -> Column:
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, line, value) as lines_of(read_documents()) has them, of files of any size.

    Files are read in blocks, written as they are read, and a block's lines are numbered from the counts of those
    before it in its file. An empty line after the last line feed isn't given, and Spark drops a byte order mark.
    """
    hidden = [p for p in paths if p.rsplit("/", 1)[-1][:1] in (".", "_")]
    shown = [p for p in paths if p not in set(hidden)]
    found = lines_of(read_documents(spark, hidden))
    if not shown:
        return found
    raw = spark.read.text(shown, lineSep="\n").select(_path().alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    kept = scratch.written(spark, raw)
    blocks = kept.groupBy("source_path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_path").orderBy("block")) - F.col("n")
    blocks = scratch.written(spark, blocks.select("source_path", "block", "first", before.alias("before")))
    few = blocks.count() <= BLOCKS
    rows = kept.join(F.broadcast(blocks) if few else blocks, ["source_path", "block"])
    numbered = rows.select("source_path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered if not hidden else numbered.unionByName(found)


def lines_of(documents: DataFrame) -> DataFrame:
    """(source_path, line, value) with lines counted from 1; a line ends at a line feed, and a return before it goes."""
    numbered = documents.select("source_path", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return numbered.select("source_path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_replace("text", "\r$", "").alias("value"))


def json_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, trimmed, with v (the parsed value) and problem (null for an object)."""
    rows = lines.withColumn("value", F.regexp_replace("value", _WHITE, "")).filter("value <> ''").withColumn("v", F.try_parse_json("value"))
    where = F.concat(F.lit("line "), F.col("line").cast("string"))
    problem = F.when(F.col("v").isNull(), F.concat(where, F.lit(": invalid JSON payload"))).when(~F.schema_of_variant("v").startswith("OBJECT"), F.concat(where, F.lit(": JSON root must be an object")))
    return rows.withColumn("problem", problem)


def items_of(documents: DataFrame, items: Column, label: str) -> DataFrame:
    """(source_path, line, value, v, root, problem) of the items of a list in each document, counted from 1.

    `items` is the list, an array of variants, by the column root.
    """
    rooted = documents.withColumn("root", F.try_parse_json("value"))
    each = rooted.select("source_path", "root", F.posexplode_outer(items).alias("at", "v"))
    rows = each.filter("v IS NOT NULL").withColumn("line", (F.col("at") + 1).cast("long")).withColumn("value", F.to_json("v"))
    problem = F.when(~F.schema_of_variant("v").startswith("OBJECT"), F.concat(F.lit(label + " "), F.col("line").cast("string"), F.lit(": entry is not an object; skipped")))
    return rows.select("source_path", "line", "value", "v", "root", problem.alias("problem"))


def document_problems(documents: DataFrame, sound: Column, message: str) -> DataFrame:
    """Warnings for documents of the wrong shape, which a parse can only reject as wholes."""
    rooted = documents.withColumn("root", F.try_parse_json("value"))
    return rooted.filter(~F.coalesce(sound, F.lit(False))).select("source_path", F.lit(0).cast("long").alias("position"), F.lit(message).alias("message"))


def variants(column: Column, path: str) -> Column:
    """The list at a path as an array of variants, or null."""
    return F.try_variant_get(column, path, "array<variant>")


def first_text(candidates: list[tuple[str, Column]], blocks: tuple[str, ...] = ()) -> Column:
    """struct<text, label> of the first candidate (label, JSON text) that has text.

    Texts lie at any depth, which SQL can't walk, so one Arrow batch of all candidates goes to Python.
    Labels in `blocks` name lists of content blocks, whose tool calls are no text.
    """
    labels = [label for label, _ in candidates]

    @F.pandas_udf("struct<text string, label string>")
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found = (None, None)
                for label, raw in zip(labels, row):
                    if raw is None:
                        continue
                    try:
                        value = json.loads(raw)
                    except ValueError:
                        continue
                    if text := (block_text if label in blocks else text_of)(value):
                        found = (text, label)
                        break
                out.append(found)
            yield pd.DataFrame(out, columns=["text", "label"])

    return of(F.struct(*(c.alias(f"c{i}") for i, (_, c) in enumerate(candidates))))


def text_candidates(variant: Column, *paths: str, prefix: str = "") -> list[tuple[str, Column]]:
    return [(prefix + p, json_at(variant, p)) for p in paths]


def padded(position: Column) -> Column:
    return F.lpad(position.cast("string"), 6, "0")


def path_mark(path: Column) -> Column:
    """16 hex digits that stand for a path in made-up ids."""
    return F.substring(F.sha2(path, 256), 1, 16)


def object_json(members: dict[str, Column]) -> Column:
    """Compact JSON of an object whose null members are left out, keys sorted."""
    return F.to_json(F.struct(*(members[k].alias(k) for k in sorted(members))))


def notes(*conditions: tuple[Column, Column]) -> Column:
    """Messages whose conditions hold."""
    return F.array_compact(F.array(*(F.when(c, m) for c, m in conditions)))


def at_line(text: Column | str, unit: str = "line") -> Column:
    return F.concat(F.lit(f"{unit} "), F.col("line").cast("string"), F.lit(": "), F.lit(text) if isinstance(text, str) else text)


def timed(rows: DataFrame, stamp: Column) -> DataFrame:
    """Columns stamp, parsed_ms, ms, utc, quality: the time as given, else the record's position as milliseconds."""
    rows = rows.withColumn("stamp", stamp).withColumn("parsed_ms", parse_ms(F.col("stamp"))).withColumn("ms", F.coalesce("parsed_ms", "line"))
    return rows.withColumns({"utc": format_ms(F.col("ms")), "quality": F.when(F.col("parsed_ms").isNull(), "fallback").otherwise("exact")})


def list_json(*values: str) -> Column:
    return F.lit(json.dumps(list(values), separators=(",", ":")))


def assemble(rows: DataFrame, adapter: str, columns: dict[str, Column], messages: Column, unit: str = "line") -> Parsed:
    """Events from sound rows, and all rows' warnings.

    `rows` has source_path, line, value, problem and what `timed` adds; `columns` gives the rest of the
    event by the mart's names. What is not given is null, or empty for lists and metadata.
    """
    base = {
        "schema_version": F.lit(schema.SCHEMA_VERSION),
        "run_id": F.lit(RUN_ID),
        "sequence_global": F.col("line") - 1,
        "sequence_source": F.col("line") - 1,
        "source_kind": F.lit(adapter),
        "source_path": F.col("source_path"),
        "source_record_locator": F.concat(F.lit(f"{unit}:"), F.col("line").cast("string")),
        "adapter_name": F.lit(adapter),
        "adapter_version": F.lit(ADAPTER_VERSION),
        "timestamp_utc": F.col("utc"),
        "timestamp_unix_ms": F.col("ms"),
        "timestamp_quality": F.col("quality"),
        "content_mime": F.lit("text/plain"),
        "content_excerpt": excerpt(columns["content_text"]),
        "flags_json": F.lit("[]"),
        "warnings_json": F.lit("[]"),
        "errors_json": F.lit("[]"),
        "raw_hash": digest(F.col("value")),
    }
    full = base | columns
    events = [full.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.EVENTS]
    all_notes = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(messages)
    warnings = rows.select("source_path", F.col("line").alias("position"), F.explode(all_notes).alias("message"))
    return Parsed(rows.filter("problem IS NULL").select(*events), warnings, rows.select(*events, F.col("line").alias("position"), "problem", all_notes.alias("notes")))
