"""From units of text to findings: a screen of lines, the exact scan of those it lets through, and what follows.

A unit is one text that is scanned as a whole: unit_id, path, text, and numbers (of its lines; null: from 1).
Texts cross into Python in Arrow batches, beside the scan of the table and without a shuffle; there a few
passes over all bytes of a batch find the lines that can hold something, and only these are scanned.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions.paths import matches_globs
from credsieve.operators.scanner import Scanner, to_bytes_text, to_text
from credsieve.operators.screen import Screen
from credsieve.plans import values as V
from credsieve.plans.catalog import RANKS
from credsieve.plans.config import Config

FINDINGS = (
    "unit_id string, file string, ord int, rule_id string, description string, severity string, rank int, tags array<string>, "
    "line int, column int, end_column int, line_text string, secret string, entropy double, entropy_bits double, context string, "
    "related string, decoded string, fingerprint string, occurrences int"
)
#: Never in a report: the raw value and what may hold it.
PRIVATE = ("secret", "line_text", "context", "related", "decoded")


def gated(files: DataFrame, config: Config) -> DataFrame:
    """Files (path, length, content) that are scanned: not ignored, not too large, not binary."""
    kept = files.where(
        ~matches_globs(F.col("path"), config.scan.ignore_paths)
        & ~matches_globs(F.col("path"), config.allowlist.paths)
        & (F.col("length") <= config.scan.max_file_size_bytes)
    )
    return kept.where(F.expr(f"position(X'00', substring(content, 1, {V.SNIFFED_BYTES})) = 0"))


def units_of_files(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("unit_id"), "path", F.expr("try_validate_utf8(cast(content as string))").alias("valid"), "content"
    ).select(
        "unit_id", "path", F.coalesce("valid", F.decode("content", "ISO-8859-1")).alias("text"), F.lit(None).cast("array<int>").alias("numbers")
    )


def units_of_table(table: DataFrame, id_col: str, text_col: str, path: Column | None = None) -> DataFrame:
    """One unit for each row of any table with a text column."""
    key = F.col(id_col).cast("string")
    return table.select(
        key.alias("unit_id"), (path if path is not None else key).alias("path"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("numbers")
    )


#: Bytes of input below which nothing is dealt anew, and below which a core may find no file split of its own.
LEAST_DEALT, SPLIT_BYTES = 4 << 20, 64 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table too small to give every core a split (a file is split between row groups only) dealt over all
    cores; larger ones as they are, without a shuffle.  The size is the optimizer's estimate."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if LEAST_DEALT <= size < cores * SPLIT_BYTES else rows


def findings(units: DataFrame, config: Config | None = None) -> DataFrame:
    """All findings of the units, before collapsing and judging."""
    from credsieve.sources.shipping import ship_package

    config = config or Config()
    ship_package(units.sparkSession)
    wanted = dealt(units).where(F.col("text").isNotNull() & ~matches_globs(F.col("path"), config.allowlist.paths))
    wanted = wanted.select("unit_id", "path", "numbers", "text")
    options = dataclasses.asdict(config)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _rebuilt(options)
        scanner, screen = Scanner(made), Screen(made)
        schema = None
        for batch in batches:
            rows = []
            paths, texts = batch.column(1).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()
            for place, wanted_lines in screen.rows(paths, texts):
                unit, numbers = batch.column(0)[place].as_py(), batch.column(2)[place].as_py()
                path, text = paths[place], texts[place].decode("utf-8", "surrogatepass")
                if numbers is None:
                    found = scanner.scan(path, text, wanted_lines)
                else:
                    lines = [x.removesuffix("\r") for x in to_bytes_text(text).split("\n")]
                    found = scanner.scan_lines(path, list(zip(numbers, lines, strict=False)), wanted_lines)
                for k, f in enumerate(found):
                    rows.append(
                        (unit, path, k, f.rule_id, f.description, f.severity, RANKS[f.severity], list(f.tags), f.line, f.column, f.end_column,
                         f.line_text, to_text(f.secret), f.entropy, f.entropy_bits, f.context, f.related, f.decoded, f.fingerprint, 1)
                    )
            schema = schema or _arrow_schema()
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return wanted.mapInArrow(scan, FINDINGS)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (x.strip().split(" ", 1) for x in FINDINGS.split(","))])


def _rebuilt(options: dict) -> Config:
    config = Config()
    for name, values in options.items():
        for key, value in values.items():
            setattr(getattr(config, name), key, value)
    return config.checked()


def public(found: DataFrame) -> DataFrame:
    """Findings without the raw value and what may hold it."""
    return found.drop(*PRIVATE)


def native_sweep(lines: DataFrame, config: Config | None = None) -> DataFrame:
    """The entropy sweep alone, as built-in functions over lines (path, number, text): no claims of other stages."""
    from credsieve.functions.text import contains_any, normalized_score, skip_reason

    config = config or Config()
    runs = F.slice(F.regexp_extract_all("text", F.lit(f"({V.TOKEN_RUN}={{0,2}})"), F.lit(1)), 1, V.TOKENS_A_LINE)
    tokens = lines.where(F.col("text").rlike(V.TOKEN_RUN)).withColumn("secret", F.explode(runs))
    tokens = tokens.where(F.octet_length("secret").between(config.entropy.min_length, config.entropy.max_length))
    near = contains_any(F.lower("text"), V.CONTEXT_KEYWORDS)
    least = F.when(near, config.entropy.threshold).otherwise(config.entropy.threshold_no_context)
    scored = tokens.where(skip_reason(F.col("secret"), F.col("text")).isNull()).withColumn("entropy", normalized_score(F.col("secret")))
    return scored.where(F.col("entropy") >= least).withColumn("severity", F.when(near, "high").otherwise("medium"))


__all__ = ["PRIVATE", "dealt", "findings", "gated", "native_sweep", "public", "units_of_files", "units_of_table"]
