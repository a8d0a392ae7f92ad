"""The command line: python -m credsieve scan|git|baseline|rules|hook|session|version ...

Exit codes: 0 nothing found (or nothing to stop), 1 findings at --fail-on or above, 2 wrong use or a failed run.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from credsieve import __version__
from credsieve.plans import config as options
from credsieve.plans.catalog import RANKS
from credsieve.sources import inputs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="credsieve", description="Finds leaked credentials.")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config", help="options as TOML; else the nearest one above the target")
    shared.add_argument("--format", choices=("text", "json", "sarif", "junit", "gitlab"))
    shared.add_argument("--output", help="file of the report; else standard output")
    shared.add_argument("--fail-on", choices=tuple(RANKS), default="low")
    shared.add_argument("--baseline", help="accepted findings")
    shared.add_argument("--show-suppressed", action="store_true")
    shared.add_argument("--no-redact", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("scan", parents=[shared]).add_argument("path")
    git = commands.add_parser("git", parents=[shared])
    git.add_argument("folder", nargs="?", default=".")
    kind = git.add_mutually_exclusive_group()
    kind.add_argument("--staged", action="store_true")
    kind.add_argument("--history", action="store_true")
    kind.add_argument("--range", dest="revisions")
    git.add_argument("--limit", type=int, default=0)
    git.add_argument("--since", default="")
    made = commands.add_parser("baseline", parents=[shared])
    made.add_argument("action", choices=("create",))
    made.add_argument("path")
    commands.add_parser("rules", parents=[shared])
    commands.add_parser("hook", parents=[shared], help="one payload of a tool on standard input")
    commands.add_parser("session", parents=[shared], help="JSON-RPC frames on standard input")
    commands.add_parser("version")
    return top


def configured(given: argparse.Namespace) -> options.Config:
    text = Path(given.config).read_text(encoding="utf-8") if given.config else ""
    return options.from_toml(text)


def decided(engine: object, payload: str) -> str:
    """The hook's answer to one payload: empty where nothing is to say."""
    spark = engine.spark
    try:
        given = json.loads(payload)
        if not isinstance(given, dict):
            raise ValueError("no object")
    except ValueError:
        if engine.config.hook.fail_open:
            return ""
        return enveloped("deny", "the payload can't be read", "")
    row = engine.decide(spark.createDataFrame([(payload,)], "payload string")).first()
    return enveloped(row["decision"], row["reason"], str(given.get("hook_event_name") or "PreToolUse")) if row else ""


def enveloped(decision: str, reason: str, event: str) -> str:
    said = {"hookEventName": event or "PreToolUse", "permissionDecision": decision, "permissionDecisionReason": f"possible credentials: {reason}"}
    return json.dumps({"hookSpecificOutput": said})


def main(arguments: list[str] | None = None, spark: object = None) -> int:
    """Runs one command; `spark` is the session to use, else one is made."""
    try:
        given = parser().parse_args(arguments)
    except SystemExit as end:
        return int(end.code or 0)
    if given.command == "version":
        print(__version__)
        return 0
    try:
        return _run(given, spark)
    except Exception as error:  # a failed run has a code of its own; values never reach the message
        print(f"credsieve: {type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}", file=sys.stderr)
        return 2


def _run(given: argparse.Namespace, spark: object) -> int:
    from pyspark.sql import SparkSession

    from credsieve.plans.engine import Engine

    config = configured(given)
    spark = spark or SparkSession.builder.appName("credsieve").getOrCreate()
    engine = Engine(spark, config)
    if given.command == "rules":
        for row in engine.rules().orderBy("rule_id").collect():
            print(f"{row['rule_id']}  [{row['severity']}]")
        return 0
    if given.command == "hook":
        if said := decided(engine, sys.stdin.read()):
            print(said)
        return 0
    if given.command == "session":
        for answer in engine.session(sys.stdin):
            print(answer, flush=True)
        return 0
    if given.command == "baseline":
        engine.create_baseline(inputs.file_units(spark, given.path, config), given.baseline)
        return 0
    more = {"baseline": inputs.read_baseline(spark, given.baseline)} if given.baseline else {}
    if given.command == "scan":
        result = engine.scan_path(given.path, **more)
    elif given.history:
        result = engine.scan_history(given.folder, given.limit, given.since, **more)
    elif given.revisions:
        result = engine.scan_range(given.folder, given.revisions, **more)
    else:
        result = (engine.scan_staged if given.staged else engine.scan_uncommitted)(given.folder, **more)
    report = result.report(given.format or config.report.format, not given.no_redact and config.report.redact, given.show_suppressed or config.report.show_suppressed)
    if given.output:
        Path(given.output).write_text(report + "\n", encoding="utf-8")
    else:
        print(report)
    return result.exit_code(given.fail_on)


if __name__ == "__main__":
    sys.exit(main())
