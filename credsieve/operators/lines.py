"""Units as lines, and windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.functions.text import contains_any
from credsieve.plans import values as V


def to_lines(units: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a line: all columns but the text, idx (from 0), number and text without its carriage return."""
    others = [c for c in units.columns if c not in (text_col, "numbers")]
    number = F.coalesce(F.get(F.col("numbers"), F.col("idx")), F.col("idx") + 1) if "numbers" in units.columns else F.col("idx") + 1
    carried = others + (["numbers"] if "numbers" in units.columns else [])
    rows = units.select(*carried, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("idx", "raw"))
    return rows.select(*others, "idx", number.alias("number"), F.regexp_replace("raw", r"\r\z", "").alias("text"))


def is_scannable(text: Column) -> Column:
    """Not empty and without an allow marker; other lines are still context for their neighbours."""
    return (text != "") & ~contains_any(text, V.ALLOW_MARKERS)


def truncated(text: Column) -> Column:
    return F.when(F.octet_length(text) > V.LINE_BYTES, F.decode(F.substring(F.encode(text, "UTF-8"), 1, V.LINE_BYTES), "UTF-8")).otherwise(text)


def with_context(lines: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Each line with its neighbours as numbered text, bounded by lines and bytes."""
    near = Window.partitionBy(unit).orderBy("idx").rowsBetween(-V.CONTEXT_RADIUS, V.CONTEXT_RADIUS)
    cut = F.when(
        F.octet_length("text") > V.CONTEXT_LINE_BYTES,
        F.concat(F.decode(F.substring(F.encode("text", "UTF-8"), 1, V.CONTEXT_LINE_BYTES), "UTF-8"), F.lit("…")),
    ).otherwise(F.col("text"))
    parts = F.collect_list(F.concat(F.col("number").cast("string"), F.lit(": "), cut, F.lit("\n"))).over(near)
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = acc["open"] & (F.octet_length(acc["text"]) + F.octet_length(part) <= V.CONTEXT_BYTES)
        return F.struct(F.when(fits, F.concat(acc["text"], part)).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    return lines.withColumn("context", F.regexp_replace(F.aggregate(parts, start, add)["text"], r"\n\z", ""))


def with_next(lines: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Each line with the text of the next one, null where numbers have a gap."""
    order = Window.partitionBy(unit).orderBy("idx")
    return lines.withColumn("next_text", F.when(F.lead("number").over(order) == F.col("number") + 1, F.lead("text").over(order)))


def without_overlaps(later: DataFrame, claimed: DataFrame, keys: tuple[str, ...] = ("unit_id", "idx")) -> DataFrame:
    """Spans (start_b, end_b) of a later stage that meet no claimed span of their line."""
    taken = claimed.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start_b").alias("__a"), F.col("end_b").alias("__b"))
    same = F.lit(True)
    for k in keys:
        same = same & (later[k] == taken[f"__{k}"])
    return later.join(taken, same & (later["start_b"] < taken["__b"]) & (later["end_b"] > taken["__a"]), "left_anti")
