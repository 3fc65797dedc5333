"""Validate JSONL events: decoding, three invariants, a quality scorecard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions.timeparse import parse_ms

#: Share of user and assistant messages that may lack text, by mode.
NULL_RATE = {"baseline": 0.4, "strict": 0.2}
#: Issues that a report lists; all are counted.
LISTED = 10_000


def requires_content() -> Column:
    """User and assistant messages must have text."""
    return (F.col("record_format") == "message") & F.col("role").isin("user", "assistant")


def _shape() -> str:
    """A pattern of the type, as schema_of_variant writes it with its keys sorted, of a record whose keys and kinds are right.

    Metadata may hold objects and lists to a depth of four. Names that aren't plain words are quoted there, and the
    pattern has no quote, so no name can pass for a type; what doesn't match is looked at key by key.
    """
    kinds = {"string": "STRING", "bigint": "BIGINT", "double": r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", "boolean": "BOOLEAN", "array<string>": "ARRAY<(?:STRING|VOID)>"}
    inner = "[^<>`]*+"
    for _ in range(4):
        inner = f"(?:[^<>`]++|<{inner}>)*+"
    out = "OBJECT<"
    for f in sorted(schema.JSONL_EVENTS, key=lambda f: f.name):
        kind = f"OBJECT<{inner}>" if f.name == "metadata" else kinds[f.dataType.simpleString()]
        listed = f.name == "metadata" or f.dataType.simpleString().startswith("array")
        out += f"{f.name}: {kind}(?:, |>$)" if f.name in schema.JSONL_REQUIRED else f"(?:{f.name}: {kind}(?:, |>$))?" if listed else f"(?:{f.name}: (?:{kind}|VOID)(?:, |>$))?"
    return f"^{out}$"


def _known(name: str, word: Column) -> Column:
    words = schema.VOCABULARIES[name]
    return word.isin(*words, *(["open_code"] if "opencode" in words else []))


def _sound(v: Column) -> Column:
    """Whether a record is sound, by its type as a whole and the values that are bound; true of all sound records but those of deep metadata."""
    fits = F.schema_of_variant(v).rlike(_shape())
    for name in schema.VOCABULARIES:
        fits = fits & _known(name, F.try_variant_get(v, f"$.{name}", "string"))
    for f in schema.JSONL_EVENTS:
        if f.dataType.simpleString() == "bigint":
            fits = fits & (F.coalesce(F.try_variant_get(v, f"$.{f.name}", "bigint"), F.lit(0)) >= 0)
    return F.coalesce(fits, F.lit(False))


def _problem(value: Column, v: Column) -> Column:
    """What is wrong with a record, key by key, or null."""
    fields = {f.name: f.dataType.simpleString() for f in schema.JSONL_EVENTS}
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(k) for k in schema.JSONL_REQUIRED)), keys))
    unknown = F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k in fields))))

    def typed(name: str, kind: str) -> Column:
        at = F.try_variant_get(v, f"$.{name}", "variant")
        what = F.schema_of_variant(at)
        empty = at.isNull() | (what == "VOID") if name not in schema.JSONL_REQUIRED else F.lit(False)
        if kind == "string":
            fits = what == "STRING"
            if name in schema.VOCABULARIES:
                fits = fits & _known(name, F.try_variant_get(v, f"$.{name}", "string"))
        elif kind == "bigint":
            fits = (what == "BIGINT") & (F.try_variant_get(v, f"$.{name}", "bigint") >= 0)
        elif kind == "double":
            fits = what.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
        elif kind == "boolean":
            fits = what == "BOOLEAN"
        elif name == "metadata":
            fits = what.startswith("OBJECT")
        else:
            fits = what.rlike(r"^ARRAY<(STRING|VOID)>$")
        if name == "metadata":
            fits, empty = what.startswith("OBJECT"), at.isNull()
        elif kind.startswith("array"):
            empty = at.isNull()
        return F.when(~F.coalesce(empty | fits, F.lit(False)), F.lit(name))

    wrong = F.array_compact(F.array(*(typed(n, k) for n, k in fields.items())))
    text = "record does not match agentlog.v1 schema: "
    return (
        F.when(v.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "record is not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit(text + "unknown field "), F.array_join(unknown, ", ")))
        .when(F.size(wrong) > 0, F.concat(F.lit(text + "invalid value for "), F.array_join(wrong, ", ")))
    )


def decode(lines: DataFrame) -> DataFrame:
    """`lines` (line, value) as line, problem (null if the record is sound), problem_kind, event (the typed record).

    A record must be an object, have the required keys, no unknown ones, values of the right type and
    known words. A null where a value is optional is accepted, and open_code stands for opencode.
    """
    body = F.trim("value")
    rows = lines.filter(body != "").select("line", body.alias("value")).withColumn("v", F.try_parse_json("value"))
    # Most records are sound, which one pattern tells. The look key by key stands in a lambda, which Spark doesn't
    # compile: it makes a method beyond what the JVM compiles, which would then run by the byte, sound records too.
    slow = F.get(F.transform(F.array(F.struct("value", "v")), lambda r: _problem(r["value"], r["v"])), F.lit(0))
    rows = rows.withColumn("problem", F.when(~_sound(F.col("v")), slow))
    problem = F.col("problem")
    typed_fields = [f"{f.name} {f.dataType.simpleString()}" for f in schema.JSONL_EVENTS]
    event = F.from_json("value", ", ".join(typed_fields))
    kind_of = F.when(F.col("v").isNull(), "invalid_json").otherwise("schema_violation")
    made = rows.select("line", "problem", F.when(problem.isNotNull(), kind_of).alias("problem_kind"), F.when(problem.isNull(), event).alias("event"))
    # As a generator's rows, so that a filter on them isn't pushed below, where the record would be parsed once more.
    return made.select("line", F.inline(F.array(F.struct("problem", "problem_kind", "event"))))


def events_of(decoded: DataFrame) -> DataFrame:
    """The sound records with their line, in the mart's columns."""
    as_mart = []
    for name in schema.EVENT_COLUMNS:
        short = name.removesuffix("_json")
        if short in schema.LIST_COLUMNS:
            as_mart.append(F.to_json(F.coalesce(F.col(f"event.{short}"), F.array().cast("array<string>"))).alias(name))
        elif short == "metadata":
            as_mart.append(F.coalesce(F.col("event.metadata"), F.lit("{}")).alias(name))
        elif name == "pii_redacted":
            as_mart.append(F.col("event.pii_redacted").cast("int").alias(name))
        elif name in ("source_kind", "adapter_name"):
            as_mart.append(F.regexp_replace(F.col(f"event.{name}"), "^open_code$", "opencode").alias(name))
        else:
            as_mart.append(F.col(f"event.{name}").alias(name))
    return decoded.filter("problem IS NULL").select("line", *as_mart)


def invariant_issues(events: DataFrame, mode: str = "baseline") -> DataFrame:
    """Broken invariants of typed events: line, kind, severity, detail.

    Text and number of a timestamp agree, both hashes are there, user and assistant messages have
    text, and the share of those without stays within the mode's limit, told at the first of them.
    """
    severity = "warning" if mode == "baseline" else "error"
    parsed = parse_ms(F.col("timestamp_utc"))
    time = F.when(parsed.isNull(), "timestamp_utc is not RFC3339").when(
        parsed != F.col("timestamp_unix_ms"), F.concat(F.lit("timestamp mismatch: timestamp_utc="), parsed.cast("string"), F.lit(", timestamp_unix_ms="), F.col("timestamp_unix_ms").cast("string"))
    )
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bare = requires_content() & (F.coalesce("content_text", F.lit("")) == "")
    found = F.array_compact(
        F.array(
            F.when(time.isNotNull(), F.struct(F.lit("error").alias("severity"), time.alias("detail"))),
            F.when(blank("raw_hash"), F.struct(F.lit("error").alias("severity"), F.lit("raw_hash must be non-empty").alias("detail"))),
            F.when(blank("canonical_hash"), F.struct(F.lit("error").alias("severity"), F.lit("canonical_hash must be non-empty").alias("detail"))),
            F.when(bare, F.struct(F.lit(severity).alias("severity"), F.lit("content_text is empty for user/assistant message record").alias("detail"))),
        )
    )
    single = events.select("line", F.explode(found).alias("x")).select("line", "x.*")
    rate = events.agg(F.count_if(bare).alias("bare"), F.count_if(requires_content()).alias("talk"), F.min(F.when(bare, F.col("line"))).alias("line"))
    share = F.col("bare") / F.nullif(F.col("talk"), F.lit(0))
    limit = NULL_RATE[mode]
    over = rate.filter(share > limit).select("line", F.lit(severity).alias("severity"), F.concat(F.lit("content_text null-rate "), F.format_string("%.2f", share), F.lit(f" exceeds {limit:.2f} threshold")).alias("detail"))
    return single.unionByName(over).select("line", F.lit("invariant_violation").alias("kind"), "severity", "detail")


def issues(decoded: DataFrame, mode: str = "baseline") -> DataFrame:
    """All issues with their order: decoding problems by line first, then invariants by line and detail."""
    broken = decoded.filter("problem IS NOT NULL").select(F.lit(0).alias("part"), "line", F.col("problem_kind").alias("kind"), F.lit("error").alias("severity"), F.col("problem").alias("detail"))
    rules = invariant_issues(events_of(decoded), mode).select(F.lit(1).alias("part"), "line", "kind", "severity", "detail")
    return broken.unionByName(rules)


def _rounded(x: float) -> int:
    return max(0, min(100, math.floor(x + 0.5)))


def score(part: int, whole: int) -> int:
    """Percent, half up; all of nothing is 100."""
    return 100 if not whole else _rounded(part / whole * 100)


def scorecard(total: int, parsed: int, sound: int, talk: int, with_text: int, exact: int, derived: int, fallback: int) -> dict:
    """Four scores, their mean, and the two weakest by score and name."""
    stamps = exact + derived + fallback
    scores = {
        "coverage": score(sound, total),
        "parse_success": score(parsed, total),
        "content_completeness": score(with_text, talk),
        "timestamp_quality": 100 if not stamps else _rounded((exact * 100 + derived * 70 + fallback * 30) / stamps),
    }
    weakest = sorted(scores, key=lambda k: (scores[k], k))[:2]
    return {"overall_score": math.floor(sum(scores.values()) / 4 + 0.5)} | {f"{k}_score": v for k, v in scores.items()} | {"weakest_dimensions": weakest}


def scorecard_counts(events: DataFrame) -> DataFrame:
    """One row of what a scorecard needs of sound events."""
    has_text = F.coalesce(F.trim("content_text"), F.lit("")) != ""
    stamp = lambda q: F.count_if(F.col("timestamp_quality") == q).alias(q)
    return events.agg(F.count("*").alias("sound"), F.count_if(requires_content()).alias("talk"), F.count_if(requires_content() & has_text).alias("with_text"), stamp("exact"), stamp("derived"), stamp("fallback"))


def agent_summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """(agent, records_validated, errors, warnings) of the five agents and of unknown lines."""
    words = events.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{a}'" for a in [*schema.ADAPTERS, "unknown"]) + ")) AS agent")
    sound = events.groupBy(F.col("source_kind").alias("agent")).agg(F.count("*").alias("records_validated"))
    named = found.join(events.select("line", "source_kind"), "line", "left").groupBy(F.coalesce("source_kind", F.lit("unknown")).alias("agent"))
    bad = named.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return words.join(sound, "agent", "left").join(bad, "agent", "left").select("agent", zero("records_validated"), zero("errors"), zero("warnings"))


def report(lines: DataFrame, mode: str = "baseline", listed: int = LISTED) -> dict:
    """The validation report over numbered lines (line, value).

    All issues are counted; the report lists the first `listed` in their order, and `issues` gives them all as a table.
    """
    decoded = decode(lines).cache()
    try:
        events = events_of(decoded)
        total, parsed = decoded.agg(F.count("*"), F.count_if(F.coalesce(F.col("problem_kind"), F.lit("")) != "invalid_json")).first()
        found = issues(decoded, mode)
        first = [r.asDict() for r in found.orderBy("part", "line", "detail").drop("part").limit(listed).collect()]
        counts = scorecard_counts(events).first().asDict()
        errors, warnings = found.agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")).first()
        return {
            "schema_version": schema.SCHEMA_VERSION,
            "mode": mode,
            "status": "fail" if errors else "warn" if warnings else "pass",
            "interpreted_exit_code": 2 if errors else 0,
            "total_records": total,
            "records_validated": counts["sound"],
            "errors": errors,
            "warnings": warnings,
            "quality_scorecard": scorecard(total, parsed, **counts),
            "per_agent_summary": {r["agent"]: {k: r[k] for k in ("records_validated", "errors", "warnings")} for r in agent_summary(events, found).collect()},
            "issues": first,
        }
    finally:
        decoded.unpersist()
