"""Scans of streams: micro-batches of units, windows over findings, and a ledger kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from credsieve.plans.config import Config
from credsieve.plans.engine import Engine
from credsieve.plans.scan import findings


def stream_findings(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings of a stream of units; stateless, so it runs in append mode."""
    return findings(units, config)


def deduplicated(found: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first finding of each fingerprint; state is bounded by the watermark."""
    return found.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["fingerprint"])


def tumbling(found: DataFrame, width: str, *keys: str, time_col: str = "ts", late: str | None = None) -> DataFrame:
    return _windowed(found, F.window(time_col, width), keys, time_col, late)


def sliding(found: DataFrame, width: str, step: str, *keys: str, time_col: str = "ts", late: str | None = None) -> DataFrame:
    return _windowed(found, F.window(time_col, width, step), keys, time_col, late)


def sessions(found: DataFrame, gap: str, *keys: str, time_col: str = "ts", late: str | None = None) -> DataFrame:
    return _windowed(found, F.session_window(time_col, gap), keys, time_col, late)


def _windowed(found: DataFrame, window: Column, keys: tuple[str, ...], time_col: str, late: str | None) -> DataFrame:
    rows = found.withWatermark(time_col, late) if late else found
    counted = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def remembered(judged: DataFrame) -> DataFrame:
    """Of a stream of cache_key, status, confidence: the first decided verdict of each key, later ones are answered from
    state; undecided ones are never kept.  Emits cache_key, status, confidence, hit."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for status, confidence in zip(frame["status"], frame["confidence"], strict=True):
                if state.exists:
                    known = state.get
                    out.append((key[0], known[0], known[1], True))
                    continue
                if status in ("secret", "false_positive"):
                    state.update((status, float(confidence)))
                out.append((key[0], status, float(confidence), False))
            yield pd.DataFrame(out, columns=["cache_key", "status", "confidence", "hit"])

    schema = "cache_key string, status string, confidence double, hit boolean"
    return judged.groupBy("cache_key").applyInPandasWithState(each, schema, "status string, confidence double", "append", GroupStateTimeout.NoTimeout)


def gate(engine: Engine, act: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decisions on a micro-batch of payloads; a batch is decided again if its sink failed."""

    def decide(batch: DataFrame, batch_id: int) -> None:
        act(engine.decide(batch), batch_id)

    return decide
