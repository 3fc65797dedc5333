"""The command line: snapshot, normalize, inspect, validate, ingest, query."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from loomstone import schema
from loomstone.operators import artifacts, ingest, inspect, normalize, validate
from loomstone.plans import benchmark, engine
from loomstone.plans.envelope import Envelope, Refused
from loomstone.sources import discovery, history, orchestrate
from loomstone.sources.records import lines_of, read_documents

# Exit codes.
DONE, FAILED, INVALID, USAGE = 0, 1, 2, 64


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstone", description="Analytics over agent activity logs, on Spark")
    for name in ("--home-dir", "--cwd", "--out-dir"):
        top.add_argument(name)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("snapshot")
    p.add_argument("--source-root")
    p.add_argument("--sample-size", type=int, default=3)
    p = commands.add_parser("normalize")
    p.add_argument("--source-root")
    p.add_argument("--fail-fast", action="store_true")
    p = commands.add_parser("inspect")
    p.add_argument("target")
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("validate")
    p.add_argument("input")
    p.add_argument("--strict", action="store_true")
    p = commands.add_parser("ingest").add_subparsers(dest="action", required=True).add_parser("refresh")
    p.add_argument("--source-root")
    p.add_argument("--fail-fast", action="store_true")
    q = commands.add_parser("query").add_subparsers(dest="action", required=True)
    p = q.add_parser("sql")
    p.add_argument("sql")
    p.add_argument("--params")
    p.add_argument("--row-cap", type=int, default=engine.ROW_CAP)
    q.add_parser("schema").add_argument("--include-internal", action="store_true")
    q.add_parser("catalog").add_argument("--verbose", action="store_true")
    p = q.add_parser("benchmark")
    p.add_argument("--corpus")
    p.add_argument("--row-cap", type=int, default=benchmark.ROW_CAP)
    return top


def _lines(spark: SparkSession, path: str):
    return lines_of(read_documents(spark, [path])).select("line", "value")


def _normalize(spark: SparkSession, args: argparse.Namespace, home: str, out: str) -> None:
    shell = os.path.join(home, ".zsh_history")
    scores = dict.fromkeys(schema.ADAPTERS, 0)
    if os.path.exists(shell):
        scores = {r["adapter"]: r["score"] for r in history.scores(history.commands(_lines(spark, shell))).collect()}
    events, warnings, health, before = orchestrate.normalize_sources(spark, home, args.source_root, scores, fail_fast=args.fail_fast)
    events = events.cache()
    n = artifacts.write_events(os.path.join(out, "events.jsonl"), events)
    artifacts.write_json(os.path.join(out, "agentlog.v1.schema.json"), schema.json_schema())
    artifacts.write_json(os.path.join(out, "stats.json"), normalize.stats(events, before))
    artifacts.write_json(os.path.join(out, "discovery", "sources.json"), discovery.sources_artifact(discovery.prioritized(scores)))
    artifacts.write_json(os.path.join(out, "discovery", "zsh_history_usage.json"), discovery.usage_artifact(scores))
    for adapter, report in sorted(health.items()):
        print(f"normalize: adapter={adapter} status={report['status']} reason={report['reason'] or 'none'} files={report['files_parsed']} events={report['events_emitted']} warnings={report['warnings_count']} errors={len(report['errors'])}")
    print(f"normalize: complete events={n} duplicates_removed={before - n} warnings={warnings.count()}")


def _ingest(spark: SparkSession, args: argparse.Namespace, home: str, out: str) -> Envelope:
    path = os.path.join(out, "events.jsonl")
    if not os.path.exists(path):
        raise Refused(Envelope.failed("ingest.refresh", "ingest_events_missing", "normalized events file is missing", {"events_path": path}))
    try:
        report = ingest.refresh(ingest.Mart(spark, os.path.join(out, "mart")), _lines(spark, path), args.source_root or home, args.fail_fast)
    except ValueError as error:
        raise Refused(Envelope.failed("ingest.refresh", "ingest_events_invalid", "normalized events could not be decoded", {"cause": str(error)})) from error
    except Exception as error:
        raise Refused(Envelope.failed("ingest.refresh", "ingest_refresh_failed", "refresh failed", {"cause": str(error)[:2000]})) from error
    try:
        artifacts.write_json(os.path.join(out, "ingest", "report.json"), report)
    except OSError as error:
        raise Refused(Envelope.failed("ingest.refresh", "ingest_report_artifact_write_failed", "failed to write ingest report", {"cause": str(error)})) from error
    return Envelope("ingest.refresh", data=report, meta={"events_path": path})


def _query(spark: SparkSession, args: argparse.Namespace, out: str) -> Envelope:
    plane = engine.QueryPlane(spark, os.path.join(out, "mart"))
    if args.action == "sql":
        return plane.sql(args.sql, args.params, args.row_cap)
    if args.action == "schema":
        return plane.schema(args.include_internal)
    if args.action == "catalog":
        return plane.catalog(args.verbose)
    return benchmark.benchmark(plane, out, args.corpus, args.row_cap)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; gives its exit code. Ingest and query print one JSON envelope and nothing else."""
    try:
        args = _parser().parse_args(argv)
    except SystemExit as stop:
        return DONE if stop.code in (0, None) else USAGE
    from loomstone.session import local_session

    quiet = args.command in ("ingest", "query")
    try:
        home, cwd = args.home_dir or os.environ["HOME"], args.cwd or os.getcwd()
        home = discovery.absolute(home, home, cwd)
        out = discovery.absolute(args.out_dir or os.path.join("~", ".loomstone", "output"), home, cwd)
        spark = spark or local_session()
        if not quiet:
            print(f"loomstone: starting `{args.command}`")
        code = DONE
        if args.command == "snapshot":
            print(f"snapshot: {json.dumps(artifacts.take_snapshot(spark, home, args.source_root, out, args.sample_size))}")
        elif args.command == "normalize":
            _normalize(spark, args, home, out)
        elif args.command == "inspect":
            report = inspect.inspect(spark, discovery.absolute(args.target, home, cwd))
            print(json.dumps(report, indent=2, ensure_ascii=False) if args.json else inspect.rendered(report))
        elif args.command == "validate":
            report = validate.report(_lines(spark, discovery.absolute(args.input, home, cwd)), "strict" if args.strict else "baseline")
            artifacts.write_json(os.path.join(out, "validate", "report.json"), report)  # before the exit code tells of errors
            print(f"validate: status={report['status']} errors={report['errors']} warnings={report['warnings']}")
            if report["errors"]:
                print(f"validate: first issue: {report['issues'][0]['detail']}", file=sys.stderr)
                code = INVALID
        else:
            print(engine.encoded(_ingest(spark, args, home, out) if args.command == "ingest" else _query(spark, args, out)))
        if not quiet:
            print(f"loomstone: completed `{args.command}` (exit_code={code})")
        return code
    except Refused as refused:
        print(engine.encoded(refused.envelope))
    except Exception as error:
        if quiet:
            print(engine.encoded(Envelope.failed(args.command, "runtime_failure", "command failed", {"cause": str(error)[:2000]})))
        else:
            print(f"loomstone: failed `{args.command}` (exit_code={FAILED})\n{error}", file=sys.stderr)
    return FAILED


if __name__ == "__main__":
    sys.exit(main())

