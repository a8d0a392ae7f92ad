"""Functions for SQL: what the scanner knows about values, for `spark.sql`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from credsieve.operators import scanner
from credsieve.sources.shipping import ship_package

_FOUND = "array<struct<rule_id: string, severity: string, line: int, column: int, fingerprint: string>>"


def register(spark: SparkSession, prefix: str = "cs_") -> list[str]:
    """Registers entropy(text), charset(text), is_placeholder(text) and scan(path, text) under `prefix`, as Arrow-batched
    functions of the session; null gives null.  Returns their names."""
    ship_package(spark)

    def of(value: object, use: object) -> object:
        return None if value is None else use(scanner.to_bytes_text(value))

    def entropy(text: pd.Series) -> pd.Series:
        return text.map(lambda x: of(x, scanner.score)).astype("float64")

    def charset(text: pd.Series) -> pd.Series:
        return text.map(lambda x: of(x, scanner.charset))

    def is_placeholder(text: pd.Series) -> pd.Series:
        words = scanner.Scanner().words
        return text.map(lambda x: of(x, lambda y: scanner.is_placeholder(y, words)))

    def scan(path: pd.Series, text: pd.Series) -> pd.Series:
        tool = scanner.Scanner()
        names = ("rule_id", "severity", "line", "column", "fingerprint")
        return pd.Series(
            [None if t is None else [{n: getattr(f, n) for n in names} for f in tool.scan(p or "", t)] for p, t in zip(path, text, strict=True)], dtype=object
        )

    made = {"entropy": (entropy, "double"), "charset": (charset, "string"), "is_placeholder": (is_placeholder, "boolean"), "scan": (scan, _FOUND)}
    for name, (use, kind) in made.items():
        spark.udf.register(prefix + name, pandas_udf(use, kind))
    return [prefix + x for x in made]
