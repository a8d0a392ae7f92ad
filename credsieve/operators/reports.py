"""Reports of findings (with verdict and suppressed): summaries as tables, documents as text.

Rows are put in order and rendered as columns; only the last step of a document gathers them.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.functions.secrets import redact, redact_in
from credsieve.plans.catalog import RANKS

TOOL, VERSION = "credsieve", "0.1.0"
FORMATS = ("text", "json", "sarif", "junit", "gitlab")


def level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def capitalised(severity: Column) -> Column:
    return F.when(severity.isin(*RANKS), F.initcap(severity)).otherwise("Unknown")


def verdict_label() -> Column:
    return F.coalesce(F.nullif(F.col("verdict.status"), F.lit("")), F.lit("unverified"))


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity and by verdict in one pass: dimension, value, n."""
    rows = found.withColumn("status", verdict_label())
    sets = rows.groupingSets([["severity"], ["status"]], "severity", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("g"))
    return sets.select(
        F.when(F.col("g") == 0, "severity").otherwise("verdict").alias("dimension"), F.coalesce("severity", "status").alias("value"), "n"
    )


def rule_index(found: DataFrame, order: str = "ord") -> DataFrame:
    """Each rule with its place (from 0) in the order of first appearance."""
    first = found.groupBy("rule_id").agg(F.min(order).alias("first"), F.min_by("description", order).alias("description"))
    return first.withColumn("rule_index", F.row_number().over(Window.orderBy("first", "rule_id")) - 1)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("file", "line", "column", "rule_id")


def shown(found: DataFrame, masked: bool = True) -> DataFrame:
    """Findings as a reader sees them: masked value, one line of its surroundings."""
    value = redact(F.col("secret")) if masked else F.col("secret")
    snippet = redact_in(F.col("line_text"), F.col("secret")) if masked else F.col("line_text")
    return found.withColumns({"shown": value, "snippet": snippet, "label": verdict_label()})


def text_lines(found: DataFrame, masked: bool = True) -> DataFrame:
    """file, line, column and the rendered block of each finding."""
    sure = F.when(F.col("verdict.confidence") > 0, F.format_string(" (confidence %.2f)", "verdict.confidence")).otherwise("")
    block = F.concat(
        F.format_string("  [%s] %s  %d:%d  %s\n    verdict: %s", "severity", "rule_id", "line", "column", "shown", "label"),
        sure,
        F.when(F.col("snippet") != "", F.concat(F.lit("\n    | "), "snippet")).otherwise(""),
    )
    return shown(found, masked).select("file", "line", "column", "rule_id", block.alias("block"))


def sarif_results(found: DataFrame, masked: bool = True) -> DataFrame:
    index = rule_index(found).select("rule_id", "rule_index")
    message = F.concat("description", F.lit(" ["), "label", F.lit("]: "), "shown")
    rows = shown(found, masked).join(F.broadcast(index), "rule_id")  # one row a rule
    return rows.select(
        "rule_id", "rule_index", level(F.col("severity")).alias("level"), message.alias("message"), "file",
        F.greatest("line", F.lit(1)).alias("start_line"), F.col("column").alias("start_column"), "end_column", "fingerprint", "suppressed", "ord",
    )


def junit_cases(found: DataFrame, masked: bool = True) -> DataFrame:
    name = F.concat_ws(":", "rule_id", "file", F.col("line").cast("string"))
    detail = F.format_string("%s secret at %s:%d (%s)", "severity", "file", "line", "shown")
    return shown(found, masked).select(
        name.alias("name"), F.col("rule_id").alias("classname"), "suppressed",
        F.when(~F.col("suppressed"), detail).alias("failure"), F.when(F.col("suppressed"), F.concat(F.lit("suppressed: "), "label")).alias("skipped"), "severity",
    )


def gitlab_vulnerabilities(found: DataFrame, masked: bool = True) -> DataFrame:
    described = F.concat("description", F.lit(" ["), "label", F.lit("]: "), "shown")
    return shown(found.where("not suppressed"), masked).select(
        F.col("fingerprint").alias("id"), F.lit("secret_detection").alias("category"), F.col("description").alias("name"), described.alias("description"),
        capitalised(F.col("severity")).alias("severity"), "file", F.greatest("line", F.lit(1)).alias("start_line"), F.col("rule_id").alias("identifier"),
    )


def render(found: DataFrame, form: str, masked: bool = True, with_suppressed: bool = False, files: int = 0, seconds: float = 0.0) -> str:
    """The whole document, on the driver."""
    if form not in FORMATS:
        raise ValueError(f"report.format: {form!r} is none of {', '.join(FORMATS)}")
    found = found.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
    active, rest = found.where("not suppressed"), found.where("suppressed")
    counts = found.agg(
        F.count_if(~F.col("suppressed")).alias("n"), F.count_if("suppressed").alias("s"), F.count_distinct(F.when(~F.col("suppressed"), F.col("file"))).alias("f")
    ).first()
    wanted = found if with_suppressed else active
    if form == "text":
        return _text(active, rest if with_suppressed else None, counts, masked, files, seconds)
    if form == "json":
        by = {"severity": {}, "verdict": {}}
        for row in summary(active).collect():
            by[row["dimension"]][row["value"]] = row["n"]
        columns = [c for c in shown(found).columns if c not in ("line_text", "context", "related", "decoded", "shown", "snippet", "label", "rank", "ord", "unit_id", *(["secret"] if masked else []))]
        view = lambda df: [json.loads(r[0]) for r in ordered(df.withColumn("secret_redacted", redact(F.col("secret")))).select(F.to_json(F.struct(*columns, "secret_redacted"))).collect()]
        return json.dumps(
            {
                "tool": TOOL, "version": VERSION, "files_scanned": files, "duration_ms": int(seconds * 1000), "findings": view(active), "suppressed": view(rest),
                "summary": {"total": counts["n"], "files": counts["f"], "suppressed": counts["s"], "by_severity": by["severity"], "by_verdict": by["verdict"]},
            },
            indent=2, ensure_ascii=False,
        )
    if form == "sarif":
        return _sarif(wanted, masked)
    if form == "junit":
        return _junit(wanted, masked, seconds)
    return _gitlab(active, masked, seconds)


def _text(active: DataFrame, rest: DataFrame | None, counts: object, masked: bool, files: int, seconds: float) -> str:
    out = []
    for title, rows in (("", active), ("\nSuppressed:", rest)):
        blocks = ordered(text_lines(rows, masked)).collect() if rows is not None else []
        out += [title] if title and blocks else []
        before = None
        for row in blocks:
            out += [f"\n{row['file']}"] if row["file"] != before else []
            out.append(row["block"])
            before = row["file"]
    out = out or [f"No secrets detected ({files} files scanned)."]
    out.append(f"\nSummary: {counts['n']} finding(s) across {counts['f']} file(s), {counts['s']} suppressed [{files} files scanned in {seconds:.3f}s]")
    return "\n".join(out) + "\n"


def _sarif(found: DataFrame, masked: bool) -> str:
    rules = rule_index(found).orderBy("rule_index").collect()
    results = []
    for r in sarif_results(found, masked).orderBy("file", "start_line", "start_column").collect():
        region = {"startLine": r["start_line"], "startColumn": r["start_column"], "endColumn": r["end_column"]}
        results.append(
            {
                "ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": r["message"]},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": region}}],
                "partialFingerprints": {f"{TOOL}/v1": r["fingerprint"]},
                **({"suppressions": [{"kind": "external"}]} if r["suppressed"] else {}),
            }
        )
    driver = {"name": TOOL, "version": VERSION, "rules": [{"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": r["description"]}} for r in rules]}
    schema = "https://json.schemastore.org/sarif-2.1.0.json"
    return json.dumps({"$schema": schema, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False)


def _junit(found: DataFrame, masked: bool, seconds: float) -> str:
    rows = junit_cases(found, masked).orderBy("name").collect()
    cases = []
    for r in rows:
        inner = f"<skipped message={quoteattr(r['skipped'])}/>" if r["suppressed"] else f"<failure message={quoteattr(r['failure'])} type={quoteattr(r['severity'])}>{escape(r['failure'])}</failure>"
        cases.append(f"  <testcase name={quoteattr(r['name'])} classname={quoteattr(r['classname'])}>{inner}</testcase>")
    cases = cases or [f'  <testcase name="no-secrets-detected" classname="{TOOL}"/>']
    failed, skipped = sum(not r["suppressed"] for r in rows), sum(bool(r["suppressed"]) for r in rows)
    head = f'<testsuite name="{TOOL}" tests="{len(cases)}" failures="{failed}" skipped="{skipped}" time="{seconds:.3f}">'
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', head, *cases, "</testsuite>"]) + "\n"


def _gitlab(found: DataFrame, masked: bool, seconds: float) -> str:
    end = datetime.now(UTC).replace(microsecond=0)
    form = "%Y-%m-%dT%H:%M:%S"
    tool = {"id": TOOL, "name": TOOL, "version": VERSION, "vendor": {"name": TOOL}}
    rows = []
    for r in gitlab_vulnerabilities(found, masked).orderBy("file", "start_line", "id").collect():
        one = {"type": f"{TOOL}_rule_id", "name": f"{TOOL} rule {r['identifier']}", "value": r["identifier"]}
        rows.append(
            {
                "id": r["id"], "category": r["category"], "name": r["name"], "message": r["name"], "description": r["description"], "cve": r["id"],
                "severity": r["severity"], "location": {"file": r["file"], "start_line": r["start_line"]}, "identifiers": [one],
            }
        )
    scan = {"analyzer": tool, "scanner": tool, "type": "secret_detection", "start_time": (end - timedelta(seconds=seconds)).strftime(form), "end_time": end.strftime(form), "status": "success"}
    return json.dumps({"version": "15.0.0", "scan": scan, "vulnerabilities": rows}, indent=2, ensure_ascii=False)


def write_baseline(found: DataFrame, path: str) -> None:
    """Accepted findings as a map by fingerprint, the last of each; readable by the owner only."""
    import os

    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    last = found.groupBy("fingerprint").agg(F.max_by(F.struct("rule_id", "file", redact(F.col("secret")).alias("secret_redacted")), F.struct("file", "line", "ord")).alias("x"))
    rows = {r[0]: {**r[1].asDict(), "accepted_at": now} for r in last.collect()}
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
        json.dump({"version": 1, "findings": dict(sorted(rows.items()))}, out, indent=2)
