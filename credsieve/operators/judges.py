"""Judges of findings: the offline ladder, programs and functions in batches, and the ledger that remembers them."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.after import batched, requests, with_offline_verdict
from credsieve.plans.config import Config

VERDICT = "struct<status:string,confidence:double,reason:string,verifier:string>"
STATUSES = ("secret", "false_positive", "uncertain")
#: A judge takes the requests of a batch and gives {index, status, confidence, reason} for each, in any order.
Judge = Callable[[list[dict]], list[dict]]


def results_in(text: str) -> list[dict]:
    """The results in a model's answer: balanced objects, wherever they stand; fences and prose around them are left out."""
    found: list[dict] = []
    decoder, at = json.JSONDecoder(), 0
    while (start := min((k for k in (text.find("{", at), text.find("[", at)) if k >= 0), default=-1)) >= 0:
        try:
            value, at = decoder.raw_decode(text, start)
        except ValueError:
            at = start + 1
            continue
        if isinstance(value, dict) and isinstance(value.get("results"), list):
            value = value["results"]
        found += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict) and "index" in x]
    return found


def mapped(results: list[dict], n: int, name: str) -> list[tuple[str, float, str, str]]:
    """One verdict a request by index: the first counts, others and those out of range are left out, missing are uncertain."""
    by: dict[int, tuple[str, float, str, str]] = {}
    for r in results:
        k = r.get("index")
        if isinstance(k, int) and 0 <= k < n and k not in by:
            status = str(r.get("status", "")).strip().lower().replace(" ", "_").replace("-", "_")
            status = status if status in STATUSES else "uncertain"
            try:
                sure = min(1.0, max(0.0, float(r.get("confidence", 0))))
            except (TypeError, ValueError):
                sure = 0.0
            by[k] = (status, sure, str(r.get("reason", "")), name)
    return [by.get(k, ("uncertain", 0.0, "no verdict", name)) for k in range(n)]


def command_judge(command: list[str], timeout: int = 45) -> Judge:
    """A program that reads requests as a JSON array and writes an object with results."""

    def judge(batch: list[dict]) -> list[dict]:
        done = subprocess.run(command, input=json.dumps(batch), capture_output=True, text=True, timeout=timeout, check=True)
        return results_in(done.stdout)

    return judge


def with_retries(judge: Judge, attempts: int = 5, pause: float = 0.5) -> Judge:
    """Again after an error, waiting twice as long each time; an error that names its own pause sets it."""
    import time

    def again(batch: list[dict]) -> list[dict]:
        for k in range(attempts):
            try:
                return judge(batch)
            except Exception as error:
                if k == attempts - 1:
                    raise
                said = re.search(r"try again in ([0-9]+(?:\.[0-9]+)?)\s*(ms|s\b)", str(error))
                time.sleep(float(said[1]) / (1000 if said[2] == "ms" else 1) if said else pause * 2**k)
        return []

    return again


def halving(judge: Judge) -> Judge:
    """A batch that fails is asked again in halves."""

    def halves(batch: list[dict]) -> list[dict]:
        try:
            return judge(batch)
        except Exception:
            if len(batch) < 2:
                raise
            half = len(batch) // 2
            rest = [{**x, "index": k} for k, x in enumerate(batch[half:])]
            return halves(batch[:half]) + [{**x, "index": x["index"] + half} for x in halves(rest)]

    return halves


def judged_in_batches(asked: DataFrame, judge: Judge, name: str, batch: int = 8, workers: int = 4, on_error: str = "keep") -> DataFrame:
    """cache_key and verdict of each request; a batch is asked once, `workers` at a time."""
    sent = ("rule_id", "description", "file", "line", "secret", "context", "entropy", "is_test_path", "block_type", "occurrences", "related", "decoded")
    rows = batched(asked.dropDuplicates(["cache_key"]), batch).select("batch_id", "index", "cache_key", F.to_json(F.struct("index", *sent)).alias("request"))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        batch_rows = [json.loads(x) for x in frame["request"]]
        try:
            found = mapped(judge(batch_rows), len(batch_rows), name)
        except Exception as error:
            if on_error == "fail":
                raise
            found = [("uncertain", 0.0, f"judge failed: {type(error).__name__}", name)] * len(batch_rows)
        return pd.DataFrame({"cache_key": frame["cache_key"].values, **{c: [x[k] for x in found] for k, c in enumerate(("status", "confidence", "reason", "verifier"))}})

    made = rows.repartition(workers, "batch_id").groupBy("batch_id").applyInPandas(ask, "cache_key string, status string, confidence double, reason string, verifier string")
    return made.select("cache_key", F.struct("status", "confidence", "reason", "verifier").alias("verdict"))


def offline(asked: DataFrame) -> DataFrame:
    """Requests with the ladder's verdict; no Python and no shuffle."""
    return with_offline_verdict(asked)


def judged(found: DataFrame, config: Config, judge: Judge | None = None, ledger: DataFrame | None = None, name: str = "judge") -> DataFrame:
    """Findings with verdict: by the ledger where it knows them, else by the judge (the offline ladder without one)."""
    if judge is None and config.ai.command:
        judge, name = command_judge(config.ai.command, config.ai.timeout_seconds), "command"
    if judge is None or config.ai.mode == "off":
        # The ladder runs here and needs the raw values, whatever may be sent elsewhere.
        raw = requests(found, config.ai.max_batch, config.ai.max_context_lines, True)
        return offline(raw).drop("is_test_path", "block_type")
    asked = requests(found, config.ai.max_batch, config.ai.max_context_lines, config.ai.send_secret)
    keyed = asked.select(*[c for c in asked.columns if c not in found.columns or c in ("unit_id", "ord", "file")])
    hits = None
    if ledger is not None:
        hits = ledger.select("cache_key", F.struct("status", "confidence", F.lit("remembered").alias("reason"), F.lit(name).alias("verifier")).alias("known"))
        asked = asked.join(hits, "cache_key", "left_anti")
    fresh = judged_in_batches(asked, judge, name, config.ai.max_batch, config.ai.max_concurrency, config.ai.on_error)
    rows = found.join(keyed.select("unit_id", "ord", "file", "cache_key"), ["unit_id", "ord", "file"]).join(fresh, "cache_key", "left")
    if hits is not None:
        rows = rows.join(hits, "cache_key", "left").withColumn("verdict", F.coalesce("verdict", "known")).drop("known")
    return rows


def write_ledger(judged_rows: DataFrame, path: str, scope: str, before: DataFrame | None = None) -> None:
    """Status and confidence by key, never values or reasons, never undecided ones; the old file is replaced whole."""
    from credsieve.sources.inputs import LEDGER_VERSION

    rows = judged_rows.where("verdict.status not in ('uncertain', 'unverified')").select("cache_key", F.col("verdict.status").alias("status"), F.col("verdict.confidence").alias("confidence"))
    if before is not None:
        rows = before.join(rows.select("cache_key"), "cache_key", "left_anti").unionByName(rows)
    entries = {r[0]: {"status": r[1], "confidence": r[2]} for r in rows.dropDuplicates(["cache_key"]).toLocalIterator()}
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as out:
        json.dump({"version": LEDGER_VERSION, "scope": scope, "entries": entries}, out)
    os.replace(temporary, path)
