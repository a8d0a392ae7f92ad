"""Unified and combined diffs, and framed commit logs, as tables of added lines.

A diff is one row; its lines are exploded and the state of the parse (file, hunk, next line number)
is running counts over the lines of that diff, so a table of diffs is parsed in one shuffle by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of hunks, of plain and of combined diffs.
HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
COMBINED_HUNK = r"^(@{3,}) (?:-[0-9]+(?:,[0-9]+)? )+\+([0-9]+)(?:,[0-9]+)? @{3,}"
RANGE = r"^[A-Za-z0-9][A-Za-z0-9._/@^~-]*(\.\.\.?[A-Za-z0-9][A-Za-z0-9._/@^~-]*)?$"
RECORD_MARK, FIELD_MARK = "\x1e", "\x1f"


def added_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """id, file_no, path, number (in the new file), text of each added line; binary and deleted files have none."""
    rows = diffs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    raw = F.col("raw")
    merge = raw.rlike("^diff --(?:cc|combined) ")
    header = merge | raw.startswith("diff --git ")
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("file_no", F.sum(header.cast("int")).over(so_far))
    combined = raw.rlike(COMBINED_HUNK)
    plain = raw.rlike(HUNK)
    hunk = raw.startswith("@@")
    rows = rows.withColumn("hunk_no", F.sum((hunk | header).cast("int")).over(so_far))
    whole_file = Window.partitionBy(id_col, "file_no")
    in_hunk_order = Window.partitionBy(id_col, "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(combined, F.regexp_extract(raw, COMBINED_HUNK, 2)).when(plain, F.regexp_extract(raw, HUNK, 1))
    parents = F.when(combined, F.length(F.regexp_extract(raw, COMBINED_HUNK, 1)) - 1).when(plain, 1)
    rows = rows.withColumns(
        {
            "start": F.first(F.when(hunk, start)).over(in_hunk_order).cast("int"),
            "parents": F.first(F.when(hunk, parents)).over(in_hunk_order),
        }
    )
    # A header's lines behave alike in a hunk or out of it, so they are set apart before lines are counted.
    meta = header | hunk | raw.rlike(r"^(?:Binary files |GIT binary patch|rename to |\+\+\+ |--- )")
    in_hunk = F.col("start").isNotNull() & ~meta
    marks = F.expr("substring(raw, 1, parents)")
    many = F.col("parents") > 1
    all_added = F.when(many, F.length(F.replace(marks, F.lit("+"), F.lit(""))) == 0).otherwise(raw.startswith("+"))
    short = many & (F.length(raw) < F.col("parents"))
    moves = F.when(many, ~short & ~F.contains(marks, F.lit("-"))).otherwise(~raw.rlike(r"^[-\\]"))
    rows = rows.withColumns({"moves": (in_hunk & moves).cast("int"), "added": in_hunk & ~short & all_added})
    new_side = F.regexp_replace(F.regexp_extract(raw, r"^\+\+\+ ([^\t]*)", 1), "^b/", "")
    named = (
        F.when(merge, F.regexp_extract(raw, "^diff --(?:cc|combined) (.*)$", 1))
        .when(header, F.regexp_extract(raw, "^diff --git .*? b/(.+)$", 1))
        .when(raw.startswith("rename to "), F.substr(raw, F.lit(11)))
        .when(raw.startswith("+++ ") & (F.regexp_extract(raw, r"^\+\+\+ ([^\t]*)", 1) != "/dev/null") & (new_side != ""), new_side)
    )
    path = F.last(named, ignorenulls=True).over(whole_file.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    binary = F.max(raw.rlike("^(?:Binary files |GIT binary patch)")).over(whole_file)
    number = F.col("start") + F.sum("moves").over(in_hunk_order) - 1
    rows = rows.withColumns({"path": F.coalesce(path, F.lit("")), "binary": binary, "number": number})
    body = F.expr("substring(raw, parents + 1)")
    return rows.where("added and not binary").select(id_col, "file_no", "path", "pos", "number", body.alias("text"))


def units_of_added_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """One unit for each file of each diff; lines keep their numbers."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "number", "text")))
    units = lines.groupBy(*keys, "file_no", "path").agg(packed.alias("x"))
    return units.select(
        *keys,
        F.concat_ws("#", *(F.col(k).cast("string") for k in keys), F.col("file_no").cast("string")).alias("unit_id"),
        "path",
        F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"),
        F.transform("x", lambda r: r["number"].cast("int")).alias("numbers"),
    )


def log_records(logs: DataFrame, text_col: str = "log") -> DataFrame:
    """hash, author, email, date, message and body (its diff) of each framed record with all five fields."""
    record = F.explode(F.split(F.col(text_col), RECORD_MARK)).alias("record")
    rows = logs.select(record).where("trim(record) != ''")
    head = F.split(F.substring_index("record", "\n", 1), FIELD_MARK)
    rows = rows.withColumn("head", head).where(F.size("head") >= 5)
    body = F.when(F.contains("record", F.lit("\n")), F.substr("record", F.instr("record", "\n") + 1)).otherwise("")
    names = ("hash", "author", "email", "date", "message")
    return rows.select(*(F.get("head", F.lit(k)).alias(n) for k, n in enumerate(names)), body.alias("body"))


def is_range(text: Column) -> Column:
    """A revision or a range of two, and no option."""
    return text.rlike(RANGE.replace("$", r"\z"))
