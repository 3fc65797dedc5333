"""Guarded SQL over a mart."""

from __future__ import annotations

import json
import time
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from loomstone.operators.ingest import Mart
from loomstone.plans import catalog, compat, guard, views
from loomstone.plans.envelope import Envelope, Refused

ROW_CAP = 1000


def value_of(x: object) -> object:
    """A cell as JSON: binary as lower-case hex, times as text."""
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [value_of(y) for y in x]
    return x


def capped(df: DataFrame, row_cap: int) -> tuple[list[dict], bool]:
    """At most `row_cap` rows as objects, and whether there are more; of equal column names the last counts."""
    rows = df.limit(row_cap + 1).collect()
    return [dict(zip(df.columns, map(value_of, r))) for r in rows[:row_cap]], len(rows) > row_cap


class QueryPlane:
    """The query commands over one mart; its views are registered anew when a table has a new version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.mart = spark, Mart(spark, root)
        self._relations: dict[str, DataFrame] = {}
        self._seen: dict[str, int] | None = None

    def relations(self) -> dict[str, DataFrame]:
        """The mart's tables as they stand now, and the views over them."""
        if not self.mart.exists():
            raise FileNotFoundError(f"no mart at {self.mart.root}")
        if self._seen != (now := self.mart.latest()):
            self._relations = views.register(self.spark, *(self.mart.read(n) for n in ("agentlog_events", "ingest_runs", "ingest_watermarks")))
            self._seen = now
        return self._relations

    def sql(self, text: str, params: str | None = None, row_cap: int = ROW_CAP) -> Envelope:
        """Run one read-only statement: guard, cap, parameters, mart, plan, rows."""
        meta = {"implemented": True, "guardrail_checked": True, "diagnostics": guard.diagnostics(text, 0, row_cap, 0, False)}

        def refuse(code: str, message: str, details: object, **more: object) -> Refused:
            return Refused(Envelope.failed("query.sql", code, message, details, **meta | more))

        try:
            guard.check_text(text)
        except guard.Violation as v:
            raise refuse("sql_guardrail_violation", str(v), v.details) from v
        if row_cap <= 0:
            raise refuse("query_row_cap_invalid", "row_cap must be greater than zero", {"row_cap": row_cap})
        try:
            values = compat.parameters(params)
        except ValueError as error:
            raise refuse("query_params_invalid", "invalid query params", {"cause": str(error)}) from error
        try:
            known = self.relations()
        except Exception as error:
            raise refuse("query_mart_unavailable", "unable to open the mart", {"mart_path": self.mart.root, "cause": str(error)}) from error
        started = time.monotonic()
        ms = lambda: int((time.monotonic() - started) * 1000)
        try:
            statement = compat.rewritten(guard.stripped(text))
            body = statement.removeprefix("EXPLAIN FORMATTED ")
            guard.check_plan(self.spark, body, list(known))
            rows, more = capped(compat.run(self.spark, statement, values), row_cap)
        except guard.Violation as v:
            raise refuse("sql_guardrail_violation", str(v), v.details) from v
        except Exception as error:
            raise refuse("query_execution_failed", "query execution failed", {"cause": str(error)[:2000]}, row_cap=row_cap, duration_ms=ms()) from error
        took = ms()
        return Envelope("query.sql", data={"rows": rows}, meta={"implemented": True, "guardrail_checked": True, "row_count": len(rows), "truncated": more, "row_cap": row_cap, "duration_ms": took, "params_count": len(values), "diagnostics": guard.diagnostics(text, took, row_cap, len(rows), more)})

    def schema(self, include_internal: bool = False) -> Envelope:
        try:
            self.mart.ensure()
            found = catalog.describe(self.relations(), include_internal)
        except Exception as error:
            raise Refused(Envelope.failed("query.schema", "query_schema_introspection_failed", "failed to introspect the mart's schema", {"mart_path": self.mart.root, "cause": str(error)[:2000]}, implemented=True, include_internal=include_internal)) from error
        n, m = len(found["tables"]), len(found["views"])
        return Envelope("query.schema", data=found, meta={"implemented": True, "include_internal": include_internal, "mart_path": self.mart.root, "table_count": n, "view_count": m, "object_count": n + m})

    def catalog(self, verbose: bool = False) -> Envelope:
        found = catalog.catalog(self.spark, verbose)
        return Envelope("query.catalog", data=found, meta={"implemented": True, "verbose": verbose, "concept_count": len(found["concepts"]), "relation_count": len(found["relations"])})


def encoded(envelope: Envelope) -> str:
    return json.dumps(envelope.as_dict(), ensure_ascii=False, separators=(",", ":"))
