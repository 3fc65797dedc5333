"""Normalize: fold duplicate events with full provenance, order them totally, count them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone import schema, scratch
from loomstone.functions.text import one_spaced, trimmed

#: Sort keys of the total order; a missing source sequence stands last.
ORDER = ["timestamp_unix_ms", "quality_rank", "source_kind", "source_path", "source_record_locator", "sequence_source", "canonical_hash", "event_id"]


def quality_rank(column: str = "timestamp_quality") -> Column:
    return F.when(F.col(column) == "exact", 0).when(F.col(column) == "derived", 1).otherwise(2)


def strategy() -> Column:
    """Which fields tell that two events are one: the canonical hash, else the place in a talk, else the place in a file."""
    placed = F.col("conversation_id").isNotNull() | F.col("turn_id").isNotNull() | F.col("content_text").isNotNull()
    return F.when(trimmed(F.col("canonical_hash")) != "", "canonical_hash").when(placed, "fallback_a").otherwise("fallback_b")


def dedupe_key() -> Column:
    """The key that events of one strategy share; no time is part of it."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    talk = F.concat_ws("|", F.col("source_kind"), text("conversation_id"), text("turn_id"), F.col("role"), F.coalesce(one_spaced(F.col("content_text")), F.lit("")))
    place = F.concat_ws("|", "source_kind", "source_path", "source_record_locator")
    return (
        F.when(F.col("dedupe_strategy") == "canonical_hash", F.concat(F.lit("canonical:"), "canonical_hash"))
        .when(F.col("dedupe_strategy") == "fallback_a", F.concat(F.lit("a:"), talk))
        .otherwise(F.concat(F.lit("b:"), place))
    )


def _metadata_size(column: str = "metadata_json") -> Column:
    return F.coalesce(F.size(F.json_object_keys(column)), F.lit(0))


def dedupe(events: DataFrame, input_order: str = "input_seq") -> DataFrame:
    """One event of each key, with dedupe_strategy, dedupe_key, dedupe_count, dedupe_members and provenance.

    The winner has the best timestamp quality, then the most metadata keys, then the smallest id, and
    of equals comes first in the input. Members are the distinct event ids. Provenance lists each
    distinct (kind, path, locator, raw hash) once, in input order. `events` carries its place in the
    input as a column that can be sorted; all of it is one grouped aggregation with partial sums before the
    shuffle. Members and provenance of one key are one row, as the report wants them, so a key's distinct
    sources must fit in a task.
    """
    marked = events.withColumn("dedupe_strategy", strategy()).withColumn("dedupe_key", dedupe_key())
    rank = F.struct(quality_rank().alias("q"), (-_metadata_size()).alias("m"), F.col("event_id").alias("e"), F.col(input_order).alias("i"))
    whole = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    source = F.struct("source_kind", "source_path", "source_record_locator", "raw_hash")
    first = marked.groupBy("dedupe_key", "dedupe_strategy", source.alias("source")).agg(F.min(input_order).alias("seq"), F.min_by(F.struct(rank.alias("r"), whole.alias("w")), rank).alias("best"), F.collect_set("event_id").alias("ids"))
    folded = first.groupBy("dedupe_key", "dedupe_strategy").agg(
        F.min_by("best.w", "best.r").alias("w"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("dedupe_members"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda p: p["source"]).alias("provenance"),
    )
    return folded.select("w.*", "dedupe_key", "dedupe_strategy", F.size("dedupe_members").alias("dedupe_count"), "dedupe_members", "provenance")


#: Hashes of keys that several events share, which are broadcast; of more, all events are dealt by their keys.
SHARED = 200_000


def dedupe_at_scale(events: DataFrame, input_order: str = "input_seq") -> DataFrame:
    """As dedupe, but an event alone with its key stays in its task; `events` is a table, since it is read twice.

    Hashes of keys are counted first, 64 bits of each. An event whose hash is its own is alone with its key, so it
    is its own winner, member and provenance; the others are folded by their keys themselves.
    """
    spark = events.sparkSession
    marked = events.withColumn("dedupe_strategy", strategy()).withColumn("dedupe_key", dedupe_key())
    mark = F.xxhash64("dedupe_strategy", "dedupe_key")
    shared = scratch.written(spark, marked.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).filter("n > 1").select("mark"))
    if shared.count() > SHARED:
        return dedupe(events, input_order)
    few = F.broadcast(shared)
    own = [F.size("dedupe_members").alias("dedupe_count"), "dedupe_members", "provenance"]
    alone = marked.withColumn("mark", mark).join(few, "mark", "left_anti").drop("mark")
    alone = alone.withColumn("dedupe_members", F.array_compact(F.array("event_id"))).withColumn("provenance", F.array(F.struct("source_kind", "source_path", "source_record_locator", "raw_hash")))
    several = marked.withColumn("mark", mark).join(few, "mark", "left_semi").select(*events.columns)
    return alone.select(*events.columns, "dedupe_key", "dedupe_strategy", *own).unionByName(dedupe(several, input_order))


def annotate(deduped: DataFrame) -> DataFrame:
    """Put the dedupe findings into metadata_json, keys sorted; they are always written, for single events too."""
    found = F.to_json(F.struct(F.col("dedupe_count"), F.col("dedupe_members"), F.col("dedupe_strategy"), F.col("provenance").alias("provenance_entries")))
    old = F.regexp_replace(F.coalesce("metadata_json", F.lit("{}")), r"\}\s*$", "")
    both = F.concat(old, F.when(trimmed(old) == "{", "").otherwise(","), F.substring(found, 2, 1 << 30))
    return deduped.withColumn("metadata_json", F.coalesce(F.to_json(F.try_parse_json(both)), found)).drop("dedupe_key", "dedupe_strategy", "dedupe_count", "dedupe_members", "provenance")


def total_order(events: DataFrame) -> DataFrame:
    """`events` with sequence_global, 0 .. n-1 in the total order, by one window.

    A window without partitions is one task: this is the plain form that tests hold `total_order_at_scale` against.
    """
    place = Window.orderBy(*_sort_columns())
    return events.withColumn("quality_rank", quality_rank()).withColumn("sequence_global", (F.row_number().over(place) - 1).cast("long")).drop("quality_rank")


def _sort_columns() -> list[Column]:
    return [F.asc_nulls_last(c) if c == "sequence_source" else F.asc(c) for c in ORDER]


def total_order_at_scale(spark: SparkSession, events: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """As total_order, without a task that sees all rows: range partitions are sorted apart and numbered from the rows before them.

    `finish` makes columns that aren't sorted by, row by row, of the sorted rows: what is made before is made once more for the bounds.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = events.withColumn("quality_rank", quality_rank())
    ranged = keyed.repartitionByRange(parts, *_sort_columns()).sortWithinPartitions(*_sort_columns()).drop("quality_rank")
    ranged = finish(ranged).withColumn("__at", F.monotonically_increasing_id())
    kept = scratch.written(spark, ranged)
    part = F.shiftright("__at", 33).cast("int")
    before, total = [], 0
    for row in sorted(kept.groupBy(part.alias("part")).count().collect()):
        before += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    if not before:
        return kept.drop("__at").withColumn("sequence_global", F.lit(None).cast("long"))
    number = F.create_map(*before)[part].cast("long") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("sequence_global", number).drop("__at")


def dedupe_and_order(events: DataFrame, input_order: str = "input_seq") -> DataFrame:
    """Canonical events: folded, annotated, ordered; columns as the mart has them."""
    return total_order_at_scale(events.sparkSession, dedupe_at_scale(events, input_order).drop("dedupe_key"), annotate).select(*schema.EVENT_COLUMNS)


def histogram(events: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(dimension, value, n) of a column, with zero for values that don't occur."""
    spark = events.sparkSession
    words = spark.sql("SELECT explode(array(" + ", ".join(f"'{v}'" for v in vocabulary) + ")) AS value")
    counts = events.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return words.join(counts, "value", "left").select(F.lit(column).alias("dimension"), "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histograms(events: DataFrame) -> DataFrame:
    """The five histograms of the normalize report, in one scan: every event gives a row to each of them."""
    spark = events.sparkSession
    dimensions = {"adapter_name": schema.ADAPTERS, "source_kind": schema.ADAPTERS, "record_format": schema.RECORD_FORMATS, "event_type": schema.EVENT_TYPES, "timestamp_quality": schema.TIMESTAMP_QUALITIES}
    words = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{v}')" for d, vs in dimensions.items() for v in vs) + " AS t(dimension, value)")
    seen = events.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    return F.broadcast(words).join(seen, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stats(events: DataFrame, input_records: int) -> dict:
    """The normalize report: counts and the five histograms."""
    names = {"adapter_name": "adapter_contributions", "source_kind": "source_contributions", "record_format": "record_format_counts", "event_type": "event_type_counts", "timestamp_quality": "timestamp_quality_counts"}
    listed = lambda c: F.coalesce(F.sum(F.size(F.from_json(c, "array<string>"))), F.lit(0))
    n, warnings, errors = events.agg(F.count("*"), listed("warnings_json"), listed("errors_json")).first()
    report: dict = {"schema_version": schema.SCHEMA_VERSION, "counts": {"input_records": input_records, "records_emitted": n, "duplicates_removed": max(0, input_records - n), "warnings": warnings, "errors": errors}}
    for row in histograms(events).orderBy("dimension", "value").collect():
        report.setdefault(names[row["dimension"]], {})[row["value"]] = row["n"]
    return report
