"""Timestamps: parsing by magnitude or RFC 3339, formatting, buckets, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import trimmed

#: Date, T or space, time with optional fraction, and an offset, which is required.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_ms(text: Column) -> Column:
    """Epoch milliseconds of a text, or null.

    An integer is seconds, milliseconds, microseconds or nanoseconds by its size; anything else must be
    RFC 3339 with an offset. A time before 1970 is null.
    """
    plain = trimmed(text)
    number = F.when(plain.rlike(r"^[+-]?\d{1,30}$"), plain.try_cast("decimal(38,0)"))
    whole = F.when(number < 100_000_000_000, number * 1000).when(number < 100_000_000_000_000, number).when(number < 10**17, F.floor(number / 1000)).otherwise(F.floor(number / 1_000_000))
    stamp = F.when(plain.rlike(_RFC3339), F.unix_millis(F.upper(F.regexp_replace(plain, " ", "T")).try_cast("timestamp")))
    found = F.when(number.isNotNull(), F.when(number >= 0, whole.try_cast("long"))).otherwise(stamp)
    return F.when(found >= 0, found)


def format_ms(ms: Column) -> Column:
    """RFC 3339 text in UTC with milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def with_fallback(parsed: Column, position: Column) -> tuple[Column, Column, Column]:
    """(ms, text, quality): the parsed time, else the record's position as milliseconds."""
    ms = F.coalesce(parsed, position.cast("long"))
    return ms, format_ms(ms), F.when(parsed.isNull(), "fallback").otherwise("exact")


def derived(anchor_ms: Column, offset_ms: Column) -> Column:
    """An anchor and an offset; null where the sum leaves the range of a long."""
    return F.try_add(anchor_ms.cast("long"), offset_ms.cast("long"))


def duration(explicit_ms: Column, start_ms: Column, end_ms: Column, guess_ms: Column) -> Column:
    """struct<duration_ms, source, quality>: explicit, else paired where the end isn't before the start, else heuristic; else null."""
    made = lambda ms, source, quality: F.struct(ms.cast("long").alias("duration_ms"), F.lit(source).alias("source"), F.lit(quality).alias("quality"))
    return (
        F.when(explicit_ms.isNotNull(), made(explicit_ms, "explicit", "high"))
        .when(end_ms >= start_ms, made(end_ms - start_ms, "paired", "medium"))
        .when(guess_ms.isNotNull(), made(guess_ms, "heuristic", "low"))
    )


def day_bucket(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def hour_bucket(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:00:00'Z'")


def rfc3339_seconds(text: Column) -> Column:
    return F.unix_seconds(text.try_cast("timestamp"))


def consistent(utc: Column, ms: Column) -> Column:
    """Whether a timestamp's text and number agree; false if the text can't be read."""
    return F.coalesce(parse_ms(utc) == ms, F.lit(False))
