"""Where units come from: file trees, tables, repositories, tool payloads, baselines and ledgers."""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.paths import matches_globs
from credsieve.plans.config import Config
from credsieve.plans.scan import gated, units_of_files
from credsieve.sources.diffs import FIELD_MARK, RECORD_MARK, RANGE, added_lines, log_records, units_of_added_lines

LEDGER_VERSION = 2
PAYLOAD = (
    "hook_event_name string, tool_name string, cwd string, tool_input struct<file_path string, content string, new_string string, "
    "edits array<struct<old_string string, new_string string>>, command string>"
)


def file_units(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """Units of the files under `path` (any store that Spark reads): names and sizes are filtered first, contents are
    read of those that are left; files that vanish or can't be read are skipped."""
    config = config or Config()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    files = reader.load(path).where(F.col("length") <= config.scan.max_file_size_bytes)
    root = F.lit(str(path).rstrip("/").removeprefix("file:") + "/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    relative = F.when(F.contains(plain, root), F.call_function("substring_index", plain, root, F.lit(-1))).otherwise(F.element_at(F.split(plain, "/"), -1))
    return units_of_files(gated(files.withColumn("path", relative), config))


def text_units(spark: SparkSession, text: str, path: str = "<scan_text>") -> DataFrame:
    return spark.createDataFrame([(path, path, text, None)], "unit_id string, path string, text string, numbers array<int>")


def diff_units(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    return units_of_added_lines(added_lines(diffs, id_col, text_col), id_col)


def log_units(logs: DataFrame, text_col: str = "log") -> DataFrame:
    """Units of what each commit of a framed log adds, with the commit's fields."""
    commits = log_records(logs, text_col)
    units = units_of_added_lines(added_lines(commits, "hash", "body"), "hash")
    return units.join(commits.drop("body"), "hash")


def payload_units(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Units of tool payloads: what a write, an edit, several edits or a command would put into the world."""
    p = payloads.withColumn("p", F.from_json(json_col, PAYLOAD)).where("p.tool_input is not null")
    given = F.col("p.tool_input")
    edits = F.when(F.size(given["edits"]) > 0, F.array_join(F.transform(given["edits"], lambda e: F.coalesce(e["new_string"], F.lit(""))), "\n"))
    text = F.coalesce(given["content"], given["new_string"], edits, given["command"])
    folder = F.concat(F.regexp_replace(F.col("p.cwd"), "/+$", ""), F.lit("/"))
    inside = F.coalesce(given["file_path"].startswith(folder), F.lit(False))
    path = F.when(inside, F.substr(given["file_path"], F.length(folder) + 1)).otherwise(F.coalesce(given["file_path"], F.lit("<command>")))
    kept = [c for c in payloads.columns if c != json_col]
    units = p.select(*kept, path.alias("path"), text.alias("text"), F.lit(None).cast("array<int>").alias("numbers"))
    return units.where("text is not null").withColumn("unit_id", F.sha2(F.concat_ws("\0", "path", "text"), 256))


def is_own_state(path: Column) -> Column:
    """The engine's own options and state are never judged."""
    return matches_globs(path, (".credsieve/**", ".credsieve-baseline.json", ".credsieve.toml", "credsieve.toml"))


def commits_something(command: Column) -> Column:
    """A shell command one of whose parts stages or commits with git, whatever global options stand between."""
    parts = F.split(command, r"&&|\|\||[;|&\n()]")
    wanted = r"^\s*(?:\w+=\S*\s+)*(?:\S*/)?git\s+(?:(?:-C|-c|--git-dir|--work-tree)(?:\s+|=)\S+\s+|--?[\w-]+(?:=\S+)?\s+)*(?:add|stage|commit)\b"
    return F.exists(parts, lambda x: x.rlike(wanted))


# ---- repositories: a subprocess on the driver ------------------------------------------------------


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def staged_units(spark: SparkSession, folder: str) -> DataFrame:
    """The staged content of files that are added, copied or modified."""
    names = [x for x in _git(folder, "diff", "--cached", "--name-only", "--diff-filter=ACM", "-z").split("\0") if x]
    rows = [(n, n, _git(folder, "show", f":{n}"), None) for n in names]
    return spark.createDataFrame(rows, "unit_id string, path string, text string, numbers array<int>")


def tracked_files(folder: str) -> list[str]:
    return [x for x in _git(folder, "ls-files", "-z").split("\0") if x]


def range_units(spark: SparkSession, folder: str, revisions: str) -> DataFrame:
    """Lines that a range of revisions adds."""
    import re

    if not re.fullmatch(RANGE.strip("^$"), revisions):
        raise ValueError(f"not a revision or range: {revisions!r}")
    return diff_units(spark.createDataFrame([(revisions, _git(folder, "diff", "-U0", revisions, "--"))], "diff_id string, diff string"))


def uncommitted_units(spark: SparkSession, folder: str) -> DataFrame:
    """Staged and unstaged added lines, and untracked files whole."""
    diffs = [("staged", _git(folder, "diff", "--cached", "-U0")), ("unstaged", _git(folder, "diff", "-U0"))]
    units = diff_units(spark.createDataFrame(diffs, "diff_id string, diff string")).drop("diff_id")
    rows = []
    for name in [x for x in _git(folder, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if x]:
        data = Path(folder, name).read_bytes()
        if b"\0" not in data[:8192]:
            rows.append((name, name, data.decode("utf-8", "replace"), None))
    more = spark.createDataFrame(rows, "unit_id string, path string, text string, numbers array<int>")
    return units.unionByName(more)


def history_units(spark: SparkSession, folder: str, limit: int = 0, since: str = "", revisions: str = "--all") -> DataFrame:
    """What each commit adds, with its fields."""
    form = f"--format={RECORD_MARK}" + FIELD_MARK.join(("%H", "%an", "%ae", "%aI", "%s"))
    args = ["log", "-p", "-U0", "--cc", form, *([f"-n{limit}"] if limit else []), *([f"--since={since}"] if since else []), revisions]
    return log_units(spark.createDataFrame([(_git(folder, *args),)], "log string"))


# ---- baselines and ledgers: small JSON maps -------------------------------------------------------


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, rule_id, file, secret_redacted, accepted_at; a missing or blank file is empty, a broken one an error."""
    schema = "fingerprint string, rule_id string, file string, secret_redacted string, accepted_at string"
    text = Path(path).read_text() if os.path.exists(path) else ""
    if not text.strip():
        return spark.createDataFrame([], schema)
    found = json.loads(text)["findings"]
    return spark.createDataFrame([(k, *(x.get(n) for n in ("rule_id", "file", "secret_redacted", "accepted_at"))) for k, x in found.items()], schema)


def read_ledger(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """cache_key, status, confidence; of another scope or version, or broken: empty; undecided verdicts are dropped."""
    schema = "cache_key string, status string, confidence double"
    try:
        said = json.loads(Path(path).read_text())
        if said["version"] != LEDGER_VERSION or said["scope"] != scope:
            raise ValueError
        rows = [(k, x["status"], float(x["confidence"])) for k, x in said["entries"].items() if x.get("status") not in (None, "", "uncertain")]
    except (OSError, ValueError, KeyError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, schema)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """path, start, end, label of a CSV of labelled ranges; T before F before X where a range has several."""
    rows = spark.read.option("header", True).csv(path).select(
        F.col("FilePath").alias("path"), F.col("LineStart").cast("int").alias("start"), F.col("LineEnd").cast("int").alias("end"), F.upper("GroundTruth").alias("label")
    )
    rank = F.when(F.col("label") == "T", 3).when(F.col("label") == "F", 2).otherwise(1)
    return rows.groupBy("path", "start", "end").agg(F.max_by("label", rank).alias("label"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, risk, info of a CSV with comments."""
    return spark.read.option("comment", "#").schema("file string, risk int, info int").csv(path)
