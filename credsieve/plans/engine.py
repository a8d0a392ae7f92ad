"""What a user asks for: scans, decisions, baselines and reports."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.operators import after, judges, reports
from credsieve.plans.catalog import RANKS, rules_table
from credsieve.plans.config import Config
from credsieve.plans.scan import findings, public, units_of_table
from credsieve.sources import inputs
from credsieve.sources.storage import stored

#: The session protocol: its version, the longest frame, and the argument that each tool can't do without.
PROTOCOL, FRAME_BYTES = "2024-11-05", 10 << 20
TOOLS = {"scan_text": "content", "scan_file": "path", "verify_finding": "secret"}


@dataclass
class ScanResult:
    """Findings, suppressed (by a baseline or a verdict) or not, and how long planning took."""

    rows: DataFrame
    seconds: float = 0.0
    units: DataFrame | None = None
    settled: bool = False

    @property
    def kept(self) -> DataFrame:
        return self.rows.where("not suppressed").drop("suppressed")

    @property
    def suppressed(self) -> DataFrame:
        return self.rows.where("suppressed").drop("suppressed")

    def all(self) -> DataFrame:
        return self.rows

    def public(self) -> DataFrame:
        return public(self.all())

    def exit_code(self, fail_on: str = "low") -> int:
        """0 without findings at this severity or above, else 1; stops at the first one."""
        return int(not after.at_least(self.kept, fail_on).isEmpty())

    def settle(self) -> ScanResult:
        """Findings stored, so that whatever is asked next reads neither the corpus nor a judge again."""
        if not self.settled:
            self.rows, self.settled = stored(self.rows, "findings"), True
        return self

    def files(self) -> int:
        """How many files (or rows) were scanned, by their paths alone."""
        return self.units.select("path").distinct().count() if self.units is not None else 0

    def report(self, form: str = "text", masked: bool = True, with_suppressed: bool = False, files: int | None = None) -> str:
        files = self.files() if files is None else files
        return reports.render(self.settle().all(), form, masked, with_suppressed, files, self.seconds)


class Engine:
    """One configuration over any source; nothing runs before a result is asked for."""

    def __init__(self, spark: SparkSession, config: Config | None = None, judge: judges.Judge | None = None):
        self.spark, self.config, self.judge = spark, config or Config(), judge

    def scan(self, units: DataFrame, baseline: DataFrame | None = None, ledger: DataFrame | None = None) -> ScanResult:
        """Detect, collapse, leave out what the baseline knows, judge the rest, set apart what is judged wrong."""
        began = time.monotonic()
        found = after.collapsed(findings(units, self.config))
        asks = (self.judge is not None or bool(self.config.ai.command)) and self.config.ai.mode != "off"
        if baseline is not None:
            found = after.with_known(found, baseline)
        if asks:  # what is asked is read several times, and a judge must be asked once
            found = stored(found, "found")
        new = found.where("not known").drop("known") if asks and baseline is not None else found
        rows = judges.judged(new, self.config, self.judge, ledger)
        rows = stored(rows, "judged") if asks else rows
        if asks and baseline is not None:
            rows = rows.withColumn("known", F.lit(False)).unionByName(found.where("known"), allowMissingColumns=True)
        rows = after.partitioned(rows, self.config.ai.filter_false_positives, self.config.ai.min_confidence)
        if baseline is not None:
            none = F.struct(F.lit("unverified").alias("status"), F.lit(0.0).cast("double").alias("confidence"), F.lit("known").alias("reason"), F.lit("baseline").alias("verifier"))
            rows = rows.withColumns({"verdict": F.when(F.col("known"), none).otherwise(F.col("verdict")), "suppressed": F.col("known") | F.col("suppressed")}).drop("known")
        return ScanResult(rows, time.monotonic() - began, units)

    def scan_path(self, path: str, **more: DataFrame) -> ScanResult:
        return self.scan(inputs.file_units(self.spark, path, self.config), **more)

    def scan_table(self, table: DataFrame, id_col: str, text_col: str, **more: DataFrame) -> ScanResult:
        return self.scan(units_of_table(table, id_col, text_col), **more)

    def scan_text(self, text: str, path: str = "<scan_text>") -> ScanResult:
        return self.scan(inputs.text_units(self.spark, text, path))

    def scan_staged(self, folder: str, **more: DataFrame) -> ScanResult:
        return self.scan(inputs.staged_units(self.spark, folder), **more)

    def scan_uncommitted(self, folder: str, **more: DataFrame) -> ScanResult:
        return self.scan(inputs.uncommitted_units(self.spark, folder), **more)

    def scan_range(self, folder: str, revisions: str, **more: DataFrame) -> ScanResult:
        return self.scan(inputs.range_units(self.spark, folder, revisions), **more)

    def scan_history(self, folder: str, limit: int = 0, since: str = "", **more: DataFrame) -> ScanResult:
        """Findings of every commit, with the commit's fields."""
        units = inputs.history_units(self.spark, folder, limit, since)
        result = self.scan(units, **more)
        commits = units.select("unit_id", "hash", "author", "email", "date", "message")
        return ScanResult(result.rows.join(commits, "unit_id", "left"), result.seconds)

    def verify(self, secret: str, context: str = "", rule_id: str = "manual") -> dict:
        """The verdict on one candidate."""
        values = (secret, rule_id, rule_id, "", 1, f"1: {context or secret}", "", "", 0.0, 1)
        row = self.spark.createDataFrame([values], "secret string, rule_id string, description string, file string, line int, context string, related string, decoded string, entropy double, occurrences int")
        from credsieve.functions.text import normalized_score

        row = row.withColumn("entropy", normalized_score(F.col("secret")))
        return judges.offline(after.requests(row)).first()["verdict"].asDict()

    def decide(self, payloads: DataFrame, json_col: str = "payload") -> DataFrame:
        """One row for each payload that is stopped: decision and reason; others have none (there is no explicit allowing)."""
        keyed = payloads.withColumn("payload_id", F.sha2(json_col, 256)).dropDuplicates(["payload_id"])
        units = inputs.payload_units(keyed.select("payload_id", json_col), json_col).where(~inputs.is_own_state(F.col("path")))
        named = units.withColumn("unit_id", F.col("payload_id"))
        kept = after.at_least(self.scan(named).kept, self.config.hook.block_on)
        said = F.concat_ws(", ", F.array_sort(F.collect_set(F.concat(F.col("rule_id"), F.lit(" at line "), F.col("line").cast("string"), F.lit(" ("), F.col("fingerprint"), F.lit(")")))))
        return kept.groupBy(F.col("unit_id").alias("payload_id")).agg(F.lit(self.config.hook.decision).alias("decision"), said.alias("reason"))

    def create_baseline(self, units: DataFrame, path: str | None = None) -> None:
        reports.write_baseline(findings(units, self.config), path or self.config.baseline.path)

    def rules(self) -> DataFrame:
        return rules_table(self.spark, self.config.active_rules())

    def answer(self, frame: str) -> str | None:
        """One frame of a newline-delimited JSON-RPC session; none for notifications."""

        def failed(code: int, message: str, to: object = None) -> str:
            return json.dumps({"jsonrpc": "2.0", "id": to, "error": {"code": code, "message": message}})

        try:
            said = json.loads(frame)
        except ValueError:
            return failed(-32700, "parse error")
        if not isinstance(said, dict):
            return failed(-32600, "invalid request")
        if "id" not in said:
            return None
        method, params = said.get("method"), said.get("params") or {}
        if method == "initialize":
            from credsieve import __version__

            result: object = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "credsieve", "version": __version__}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": x, "inputSchema": {"type": "object", "required": [needs]}} for x, needs in TOOLS.items()]}
        elif method == "tools/call" and isinstance(params, dict) and params.get("name") in TOOLS:
            name, given = params["name"], params.get("arguments")
            if not isinstance(given, dict) or not isinstance(given.get(TOOLS[name]), str):
                return failed(-32602, f"{name} needs {TOOLS[name]}, a string", said["id"])
            if name == "scan_text":
                result = self._found(self.scan_text(given["content"], given.get("filename") or "<scan_text>"))
            elif name == "scan_file":
                result = self._found(self.scan_path(given["path"]))
            else:
                result = self.verify(given["secret"], given.get("context") or "", given.get("rule_id") or "manual")
        else:
            return failed(-32601, "unknown method or tool", said["id"])
        return json.dumps({"jsonrpc": "2.0", "id": said["id"], "result": result})

    def session(self, frames: Iterable[str]) -> Iterator[str]:
        """Answers to the frames of a session.  A frame beyond FRAME_BYTES is refused, one that fails is answered with
        the kind of its error, and the session goes on."""
        for frame in frames:
            if len(frame) > FRAME_BYTES:
                yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "frame too large"}})
                continue
            if not frame.strip():
                continue
            try:
                answer = self.answer(frame)
            except Exception as error:
                answer = json.dumps({"jsonrpc": "2.0", "id": json.loads(frame).get("id"), "error": {"code": -32603, "message": type(error).__name__}})
            if answer is not None:
                yield answer

    @staticmethod
    def _found(result: ScanResult) -> list[dict]:
        return [json.loads(x) for x in result.public().toJSON().collect()]


__all__ = ["RANKS", "Engine", "ScanResult"]
