"""The JSON envelope of a query command, and the codes of its errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

ENVELOPE_VERSION = "loomstone.query-envelope.v1"
# Error codes of the query and ingest commands.
CODES = [
    "sql_guardrail_violation",
    "query_row_cap_invalid",
    "query_params_invalid",
    "query_mart_unavailable",
    "query_execution_failed",
    "query_response_encode_failed",
    "query_schema_introspection_failed",
    "query_benchmark_corpus_invalid",
    "query_benchmark_preflight_failed",
    "query_benchmark_artifact_write_failed",
    "query_benchmark_encode_failed",
    "query_benchmark_plan_missing",
    "answer_contract_mismatch",
    "ingest_events_missing",
    "ingest_events_invalid",
    "ingest_sqlite_failure",
    "ingest_refresh_failed",
    "ingest_report_artifact_write_failed",
    "ingest_report_encode_failed",
    "ingest_response_encode_failed",
]


@dataclass
class Envelope:
    command: str
    ok: bool = True
    data: object = None
    meta: dict = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)
    error: dict | None = None

    @classmethod
    def failed(cls, command: str, code: str, message: str, details: object = None, **meta: object) -> Envelope:
        error = {"code": code, "message": message} | ({} if details is None else {"details": details})
        return cls(command, ok=False, meta=dict(meta), error=error)

    def warn(self, code: str, message: str, details: object = None) -> Envelope:
        self.warnings.append({"code": code, "message": message} | ({} if details is None else {"details": details}))
        return self

    def as_dict(self) -> dict:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        out: dict = {"ok": self.ok, "command": self.command, "generated_at_utc": now}
        if self.data is not None:
            out["data"] = self.data
        out |= {"meta": {"schema_version": ENVELOPE_VERSION} | self.meta, "warnings": self.warnings}
        return out | ({"error": self.error} if self.error else {})


class Refused(Exception):
    """A command that ends in an error envelope."""

    def __init__(self, envelope: Envelope) -> None:
        super().__init__(envelope.error["message"] if envelope.error else "")
        self.envelope = envelope
