"""Redaction of secrets and personal data: text, then whole JSON values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import truncated

TOKEN = "[REDACTED]"
LIMIT = 240
#: Fixed values: (class, pattern, replacement) in the order in which they apply.
CLASSES = [
    ("private_key_pem", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", TOKEN),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9._=\-]{8,}", f"Bearer {TOKEN}"),
    ("api_token", r"\b(?:sk-[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{8,}|xox[baprs]-[A-Za-z0-9\-]{8,})\b", TOKEN),
    ("secret_assignment", r"(?i)\b(password|passwd|secret|api[_\-]?key|token)\b(\s*[:=]\s*)([^\s,;\"']+)", rf"$1$2{TOKEN}"),
    ("url_query_token", r"(?i)([?&](?:access_token|token|api_key)=)([^&\s]+)", rf"$1{TOKEN}"),
    ("email", r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", TOKEN),
    ("phone", r"\b\+?\d[\d\-\(\) ]{8,}\d\b", TOKEN),
]


def looks_binary(text: Column) -> Column:
    """A NUL, or 16 characters and more of which a fifth are control characters other than line feed, return and tab."""
    n = F.char_length(text)
    control = n - F.char_length(F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]", ""))
    return F.contains(text, F.lit("\x00")) | ((n >= 16) & (control * 5 >= n))


def steps(text: Column) -> list[tuple[str, Column]]:
    """The text after each class in turn; a later class sees what earlier ones have written."""
    out = [("binary_blob", F.when(looks_binary(text), F.lit(TOKEN)).otherwise(text))]
    for name, pattern, replacement in CLASSES:
        out.append((name, F.regexp_replace(out[-1][1], "(?U)" + pattern, replacement)))
    return out


def redacted(text: Column) -> Column:
    return steps(text)[-1][1]


def redaction(text: Column, limit: int = LIMIT) -> Column:
    """struct<text, pii_redacted, truncated, classes>: redacted first, then cut; a class counts if it changed the text."""
    before, hit = text, []
    for name, after in steps(text):
        hit.append(F.when(after != before, F.lit(name)))
        before = after
    classes = F.array_sort(F.array_compact(F.array(*hit)))
    return F.struct(truncated(before, limit).alias("text"), (F.size(classes) > 0).alias("pii_redacted"), (F.char_length(before) > limit).alias("truncated"), classes.alias("classes"))


def secret(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.lit(TOKEN)).otherwise(text)


_COMPILED = [(name, re.compile(pattern), replacement.replace("$1", r"\1").replace("$2", r"\2")) for name, pattern, replacement in CLASSES]
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def _redact_string(text: str, limit: int, classes: set[str]) -> tuple[str, bool]:
    if "\x00" in text or len(text) >= 16 and len(_CONTROL.findall(text)) * 5 >= len(text):
        text = TOKEN
        classes.add("binary_blob")
    for name, pattern, replacement in _COMPILED:
        changed = pattern.sub(replacement, text)
        if changed != text:
            classes.add(name)
            text = changed
    if len(text) <= limit:
        return text, False
    return (text[: limit - 3] + "..." if limit > 3 else "." * limit), True


def redact_value(value: object, limit: int = LIMIT) -> tuple[object, set[str], bool]:
    """(value, classes, whether something was cut) with every string redacted; keys stay."""
    classes: set[str] = set()
    cut = False

    def walk(x: object) -> object:
        nonlocal cut
        if isinstance(x, str):
            text, short = _redact_string(x, limit, classes)
            cut = cut or short
            return text
        if isinstance(x, list):
            return [walk(y) for y in x]
        if isinstance(x, dict):
            return {k: walk(y) for k, y in x.items()}
        return x

    return walk(value), classes, cut


def redact_json(column: Column, limit: int = LIMIT) -> Column:
    """struct<json, pii_redacted, truncated, classes> of JSON text; a tree of any depth, so not one of SQL's functions."""

    @F.pandas_udf("struct<json string, pii_redacted boolean, truncated boolean, classes array<string>>")
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            rows = []
            for text in texts:
                try:
                    value, classes, cut = redact_value(json.loads(text), limit)
                    rows.append((json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), bool(classes), cut, sorted(classes)))
                except (TypeError, ValueError):
                    rows.append((None, False, False, []))
            yield pd.DataFrame(rows, columns=["json", "pii_redacted", "truncated", "classes"])

    return of(column)
