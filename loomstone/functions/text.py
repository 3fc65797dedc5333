"""Text functions: Unicode trimming, excerpts, truncation, key=value tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_CHARS = 280


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    """Trimmed, or null if nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def excerpt(text: Column, most: int = EXCERPT_CHARS) -> Column:
    """The one-spaced text, cut to `most` characters and marked by three dots; null if it is empty."""
    flat = one_spaced(text)
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(F.nullif(flat, F.lit("")))


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters with the dots counted; a limit of three or fewer is dots alone."""
    if most <= 3:
        return F.when(F.char_length(text) > most, F.lit("." * most)).otherwise(text)
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def truncated_bytes(text: Column, most: Column | int) -> Column:
    """Whole characters of at most `most` UTF-8 bytes, the dots of a cut text counted.

    The cut is found in the bytes: a byte of the form 10xxxxxx continues a character.
    """
    limit = F.lit(most) if isinstance(most, int) else most
    raw = text.cast("binary")
    room = F.greatest(limit - 3, F.lit(0))
    starts = lambda n: (F.conv(F.hex(F.substring(raw, n + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0)) != 0x80
    cut = F.coalesce(*(F.when(starts(room - k), room - k) for k in range(4)), room)
    short = F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.when(limit <= 3, F.repeat(F.lit("."), limit)).otherwise(F.concat(short, F.lit("..."))))


def key_values(tokens: Column) -> Column:
    """map of key=value tokens; both sides must be there, and of equal keys the last counts."""
    pairs = F.filter(tokens, lambda t: t.rlike("^[^=]+=.+$"))
    entries = F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, "^[^=]+=", "").alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda o, j: (o["key"] == e["key"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def hex_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def digest(*parts: Column) -> Column:
    """Lower-case SHA-256 of the parts, which a unit separator keeps apart; a null part is empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
