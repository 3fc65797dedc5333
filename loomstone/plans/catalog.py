"""What the mart holds: its schema, and the semantic catalog, both derived from the tables and views themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomstone import schema
from loomstone.operators.ingest import TABLES
from loomstone.plans import views

CATALOG_VERSION = "loomstone.semantic-catalog.v1"
INTERNAL = ["agentlog_schema_meta"]
# What one row of each concept's view stands for.
GRAINS = {
    "tool_calls": ["run_id", "tool_call_id"],
    "sessions": ["run_id", "session_id"],
    "adapters": ["adapter_name"],
    "quality": ["adapter_name", "timestamp_quality"],
}
LEDGERS = ["ingest_runs", "ingest_watermarks"]


def _summary(view) -> str:
    return view.__doc__.strip().split("\n")[0]


def _numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType) and not field.name.endswith("_unix_ms")


def concept(name: str, shapes: dict[str, T.StructType], verbose: bool) -> dict:
    """One view's entry: strings are its dimensions, numbers its metrics, and a view whose whole key it holds can be joined."""
    view, key, shape = f"v_{name}", GRAINS[name], shapes[name]
    columns = shape.fieldNames()
    metrics = [f.name for f in shape if _numeric(f)]
    reachable = {to: k for to, k in GRAINS.items() if to != name and set(k) <= set(columns)}
    entry = {
        "concept_id": name,
        "primary_relation": view,
        "description": _summary(views.VIEWS[view]),
        "grain": " + ".join(key),
        "key_fields": [*key, *(c for c in columns if c.endswith("event_id"))],
        "suggested_dimensions": [f.name for f in shape if isinstance(f.dataType, T.StringType)],
        "suggested_metrics": [*metrics, "count(*)"],
        "default_ordering": [f"{c} DESC" for c in metrics[:1]] + [f"{c} ASC" for c in key],
        "joins": [{"concept": to, "relation": f"v_{to}", "join_type": "left", "on": " AND ".join(f"{view}.{c} = v_{to}.{c}" for c in k), "purpose": f"{to} by {', '.join(k)}"} for to, k in reachable.items()],
    }
    if verbose:
        entry["field_catalog"] = [{"name": f.name, "description": f"{f.name.replace('_', ' ')} ({f.dataType.simpleString()})"} for f in shape]
    return entry


def relations() -> list[dict]:
    """The views and the ledgers' tables; what each holds, by its docstring or its key."""
    found = [{"name": name, "kind": "view", "description": _summary(view)} for name, view in views.VIEWS.items()]
    return found + [{"name": name, "kind": "table", "description": f"{len(TABLES[name])} columns by {', '.join(schema.PRIMARY_KEYS[name])}"} for name in LEDGERS]


def catalog(spark: SparkSession, verbose: bool = False) -> dict:
    """Concepts and relations; fields only if asked for. Needs no mart: the views' shapes are those over no events."""
    nothing = spark.createDataFrame([], schema.EVENTS)
    shapes = {name: views.VIEWS[f"v_{name}"](nothing).schema for name in GRAINS}
    return {"schema_version": CATALOG_VERSION, "concepts": [concept(name, shapes, verbose) for name in GRAINS], "relations": relations()}


def _columns(name: str, kind: T.StructType) -> list[dict]:
    key = schema.PRIMARY_KEYS.get(name, [])
    required = set(schema.REQUIRED_COLUMNS) if name == "agentlog_events" else set()
    return [
        {
            "ordinal": i,
            "name": f.name,
            "declared_type": f.dataType.simpleString(),
            "nullable": f.nullable and f.name not in required,
            "default": schema.DEFAULTS.get((name, f.name)),
            "primary_key_position": key.index(f.name) + 1 if f.name in key else 0,
        }
        for i, f in enumerate(kind)
    ]


def describe(found: dict[str, DataFrame], include_internal: bool = False) -> dict:
    """Tables, then views, by name, with their columns: place, name, type, whether null may stand, default, place in the key."""
    tables = [{"name": n, "kind": "table", "columns": _columns(n, k)} for n, k in sorted(TABLES.items()) if include_internal or n not in INTERNAL]
    shown = [{"name": n, "kind": "view", "columns": _columns(n, df.schema)} for n, df in sorted(found.items()) if n.startswith("v_")]
    return {"tables": tables, "views": shown}
