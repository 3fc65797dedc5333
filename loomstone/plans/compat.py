"""Rewrites for SQL written for a small embedded engine: numbered parameters, date functions, iif, EXPLAIN QUERY PLAN.

A subset, by design: only text outside string literals and quoted names is rewritten, and anything
else keeps Spark's meaning (see the README for what differs).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

_PIECES = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
#: Format letters of strftime and what they are in Spark's patterns.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD", "%%": "%"}


def _outside(sql: str, change) -> str:
    return "".join(p if i % 2 else change(p) for i, p in enumerate(_PIECES.split(sql)))


def numbered_parameters(sql: str) -> str:
    """?1 becomes :p1; a bare ? takes the number after the last."""
    last = 0

    def one(m: re.Match) -> str:
        nonlocal last
        last = int(m[1]) if m[1] else last + 1
        return f":p{last}"

    return _outside(sql, lambda text: re.sub(r"\?(\d*)", one, text))


def spark_pattern(style: str) -> str:
    """A Spark date pattern for a strftime style; other letters are quoted."""
    out, at = "", 0
    for m in re.finditer(r"%[a-zA-Z%]", style):
        plain = style[at : m.start()]
        out += re.sub(r"[A-Za-z]+", lambda x: f"'{x[0]}'", plain) + _FORMATS.get(m[0], m[0])
        at = m.end()
    return out + re.sub(r"[A-Za-z]+", lambda x: f"'{x[0]}'", style[at:])


def _arguments(sql: str, start: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at `start`, and where it ends."""
    depth, parts, at, i = 0, [], start + 1, start
    while i < len(sql):
        c = sql[i]
        if c == "'":
            i = sql.index("'", i + 1) if "'" in sql[i + 1 :] else len(sql) - 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*parts, sql[at:i].strip()], i + 1
        elif c == "," and depth == 1:
            parts.append(sql[at:i].strip())
            at = i + 1
        i += 1
    raise ValueError("a bracket is not closed")


def _moment(arguments: list[str]) -> str:
    if not arguments or arguments[0].lower() == "'now'":
        return "current_timestamp()"
    if len(arguments) > 1 and arguments[1].lower() == "'unixepoch'":
        return f"timestamp_seconds(try_cast(({arguments[0]}) AS DOUBLE))"
    return f"try_cast(({arguments[0]}) AS TIMESTAMP)"


def _call(name: str, arguments: list[str]) -> str:
    if name == "iif":
        return f"CASE WHEN {arguments[0]} THEN {arguments[1]} ELSE {arguments[2]} END"
    if name == "julianday":
        return f"(unix_micros({_moment(arguments)}) / 86400000000.0D + 2440587.5D)"
    style, when = arguments[0].strip("'"), _moment(arguments[1:])
    if style == "%s":
        return f"cast(unix_seconds({when}) AS STRING)"
    pattern = spark_pattern(style).replace("'", "''")
    return f"date_format({when}, '{pattern}')"


def functions(sql: str) -> str:
    """strftime, julianday and iif as Spark has them."""
    at = 0
    while m := re.compile(r"\b(strftime|julianday|iif)\s*\(", re.I).search(sql, at):
        if sql[: m.start()].count("'") % 2:
            at = m.end()
            continue
        arguments, end = _arguments(sql, m.end() - 1)
        new = _call(m[1].lower(), [functions(a) for a in arguments])
        sql = sql[: m.start()] + new + sql[end:]
        at = m.start() + len(new)
    return sql


def rewritten(sql: str) -> str:
    sql = re.sub(r"^\s*explain\s+(query\s+plan\s+)?(?=select|with)", lambda m: "EXPLAIN FORMATTED ", sql, flags=re.I)
    return numbered_parameters(functions(sql))


def parameters(raw: str | None) -> list:
    """Bind values from JSON: a list of scalars, or one; booleans are 0 and 1; nothing nested."""
    if raw is None or not raw.strip():
        return []
    value = json.loads(raw)
    values = value if isinstance(value, list) else [value]
    if any(isinstance(v, (list, dict)) for v in values):
        raise ValueError("query params must be scalars")
    return [int(v) if isinstance(v, bool) else v for v in values]


def run(spark: SparkSession, sql: str, values: list):
    return spark.sql(sql, {f"p{i}": v for i, v in enumerate(values, 1)}) if values else spark.sql(sql)
