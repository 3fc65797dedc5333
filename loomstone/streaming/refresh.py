"""The refresh as a stream: JSONL files that arrive are validated and put into the mart batch by batch.

The batch engine's refresh has no event-time state, so a stream of files is `foreachBatch` over it:
an upsert by event id makes a batch that is run again after a failure harmless. Hourly activity is
the one stateful view, with a watermark for late events.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomstone import schema
from loomstone.operators import ingest, validate


def incoming_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSONL files of a folder as (source_path, value) rows."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder).select(F.col("_metadata.file_path").alias("source_path"), "value")


def refresh_stream(mart: ingest.Mart, lines: DataFrame, source_root: str) -> DataStreamWriter:
    """Put every batch of lines into the mart; start it with a checkpoint location and a trigger.

    A run is named by its source and batch, so a batch that is run again has one ledger row.
    """
    source = hashlib.sha256(source_root.encode()).hexdigest()[:12]

    def put(batch: DataFrame, number: int) -> None:
        numbered = batch.select((F.monotonically_increasing_id() + 1).alias("line"), "value")
        ingest.refresh(mart, numbered, source_root, run_id=f"stream-{source}-{number:012d}")

    return lines.writeStream.foreachBatch(put)


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, adapter_name, events, tool_calls) of a stream of canonical events; events later than `late` are left out."""
    timed = events.withColumn("at", F.timestamp_millis("timestamp_unix_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "adapter_name").agg(F.count("*").alias("events"), F.count_if(F.col("record_format") == "tool_call").alias("tool_calls"))


def typed_events(lines: DataFrame) -> DataFrame:
    """Sound events of a stream of lines, in the mart's columns."""
    return validate.events_of(validate.decode(lines.select(F.lit(0).cast("long").alias("line"), "value"))).select(*schema.EVENT_COLUMNS)
