"""Text and scalars from JSON of unknown shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import non_empty

# Keys that hold text, in order of preference, and keys that never do.
TEXT_KEYS = ["text", "content", "message", "value", "output", "input", "body", "prompt", "parts"]
PLAIN_KEYS = ["id", "type", "role", "name", "model", "provider", "timestamp", "created_at", "updated_at", "status", "kind", "index"]


def text_of(value: object) -> str | None:
    """The text in a JSON value: a string itself, a list's texts on lines of their own, an object's by its keys."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, list):
        return "\n".join(t for t in map(text_of, value) if t) or None
    if isinstance(value, dict):
        for key in TEXT_KEYS:
            if text := text_of(value.get(key)):
                return text
        others = sorted(set(value) - {*TEXT_KEYS, *PLAIN_KEYS})
        return "\n".join(t for t in (text_of(value[k]) for k in others) if t) or None
    return None


def block_text(value: object) -> str | None:
    """Text of a list of content blocks: texts and thoughts, but not tool calls and their results."""
    if not isinstance(value, list):
        return text_of(value)
    found = []
    for item in value:
        if isinstance(item, dict):
            if item.get("type") in ("tool_use", "tool_result"):
                continue
            text = text_of(item.get("text")) or text_of(item.get("thinking")) or text_of({k: v for k, v in item.items() if k not in ("text", "thinking", "signature")})
        else:
            text = text_of(item)
        if text:
            found.append(text)
    return "\n".join(found) or None


def _mapped(function) -> object:
    @F.pandas_udf("string")
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            out = []
            for text in texts:
                try:
                    out.append(None if text is None else function(json.loads(text)))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return of


def extract_text(json_text: Column) -> Column:
    """text_of a column of JSON text; the depth is unbounded, so it is Python over Arrow batches."""
    return _mapped(text_of)(json_text)


def extract_blocks(json_text: Column) -> Column:
    return _mapped(block_text)(json_text)


def kind_of(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def at(variant: Column, path: str) -> Column:
    """What stands at a dotted path, or null; JSON null is null too."""
    found = F.try_variant_get(variant, "$." + path, "variant")
    return F.when(F.schema_of_variant(found) != "VOID", found)


def present(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, "$." + path, "variant").isNotNull()


def string_at(variant: Column, path: str) -> Column:
    """A non-empty trimmed string; other kinds are null."""
    found = F.try_variant_get(variant, "$." + path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", non_empty(F.try_variant_get(variant, "$." + path, "string")))


def scalar_at(variant: Column, path: str) -> Column:
    """A non-empty string, number or boolean as text."""
    found = F.try_variant_get(variant, "$." + path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), non_empty(F.try_variant_get(variant, "$." + path, "string")))


def first_string(variant: Column, *paths: str) -> Column:
    return F.coalesce(*(string_at(variant, p) for p in paths))


def first_scalar(variant: Column, *paths: str) -> Column:
    return F.coalesce(*(scalar_at(variant, p) for p in paths))


def number_at(variant: Column, path: str) -> Column:
    """A whole number that isn't negative, from a number or a numeric string."""
    found = F.try_variant_get(variant, "$." + path, "string").try_cast("long")
    return F.when(found >= 0, found)


def json_at(variant: Column, path: str) -> Column:
    """Compact JSON text with sorted keys, or null."""
    found = at(variant, path)
    return F.when(found.isNotNull(), F.to_json(found))


def first_present_string(variant: Column, *paths: str) -> Column:
    """The string at the first path that is there at all; a path that holds something else ends the search."""
    out = F.lit(None).cast("string")
    for path in reversed(paths):
        out = F.when(present(variant, path), string_at(variant, path)).otherwise(out)
    return out


def json_object(**columns: Column) -> Column:
    """Compact JSON text of an object; null members are left out. Members are strings, numbers or booleans."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(columns.items()))))
