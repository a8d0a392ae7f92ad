"""Exact deduplication: two-pass Bloom filtering, DataFrame functions only.

Pass one counts, for a filter of bounded size, how many texts set each bit; bits set twice or more
form a second filter.  Pass two probes it: a text whose bits are not all in it occurs once, for
certain, and goes straight through.  Only the rest (repeated texts and the filter's few false
positives) shuffle, by their full SHA-256, so the result is exact whatever the filter says.

The text is read once, for its hash; later steps read the stored hashes (about 50 bytes a row).
Groups that hold a thousandth of all rows or more are at most a thousand, so they are broadcast and
their rows stay where they are; all others are dealt by hash.

Null texts count as empty and are equal to each other.  Of equal texts the row with the smallest id
stays (null ids last); of rows equal in id and text, one stays.  An empty table gives no rows.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import SPACES, hot_rows, plain_text, quoted, stored

#: Bits for each row, and the most bits: what is broadcast never exceeds 2**21 words of 16 bytes.
BITS_PER_ROW, MOST_BITS, LEAST_BITS = 16, 1 << 27, 1 << 10

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(df: DataFrame, text_col: str) -> Column:
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(plain_text(df, text_col), SPACES, " ")


def text_sha256(df: DataFrame, text_col: str) -> Column:
    return F.sha2(normalised(df, text_col), 256)


def _places(hash_col: str, bits: int) -> list[Column]:
    """The two bits of a row."""
    h = F.xxhash64(hash_col)
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 33).bitwiseAND(F.lit(bits - 1))]


def _repeated_words(keys: DataFrame, bits: int) -> DataFrame:
    """The second filter: 64-bit words of those bits that two or more rows set."""
    set_bits = keys.select(F.explode(F.array_distinct(F.array(*_places("__sha", bits)))).alias("bit"))
    twice = set_bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    )


def _probe(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """`rows` with `__maybe`: false means that the text occurs once."""
    for k, place in enumerate(_places("__sha", bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"__word{k}"), F.col("mask").alias(f"__mask{k}")))
        rows = (
            rows.withColumn(f"__place{k}", place)
            .withColumn(f"__word{k}", F.shiftright(f"__place{k}", 6))
            .join(side, f"__word{k}", "left")
        )
    hit = [
        F.coalesce(F.getbit(F.col(f"__mask{k}"), F.col(f"__place{k}").bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
        for k in range(2)
    ]
    return rows.withColumn("__maybe", hit[0] & hit[1]).drop(*(f"__{x}{k}" for x in ("word", "mask", "place") for k in range(2)))


def _groups(keys: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Groups of two rows or more, the filter, its bits and the number of rows."""
    total = keys.count()
    bits = LEAST_BITS
    while bits < min(most_bits, BITS_PER_ROW * total):
        bits *= 2
    words = stored(_repeated_words(keys, bits), "bloom")
    by_id = (
        _probe(keys, words, bits).where("__maybe").groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("n"))
    )
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("n").alias("n")))
    groups = by_id.groupBy("__sha").agg(F.sum("n").alias("group_size"), first.alias("first")).where("group_size > 1")
    groups = groups.select("__sha", "group_size", F.col("first.id").alias("keep_id"), F.col("first.n").alias("__same"))
    return stored(groups, "groups"), words, bits, total


def _assigned(rows: DataFrame, groups: DataFrame, words: DataFrame, bits: int, total: int) -> DataFrame:
    """`rows` (with __sha, __id) with keep_id, group_size and __same: how many rows share the first's id."""
    hot = F.col("group_size") >= hot_rows(total)
    probed = _probe(rows, words, bits)
    in_hot = probed.join(F.broadcast(groups.where(hot)), "__sha", "left")
    here = in_hot.where(~F.col("__maybe") | F.col("group_size").isNotNull())
    dealt = (
        probed.where("__maybe")
        .join(F.broadcast(groups.where(hot).select("__sha")), "__sha", "left_anti")
        .join(groups.where(~hot), "__sha", "left")
    )
    both = here.unionByName(dealt)
    return both.withColumns(
        {
            "keep_id": F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
            "__same": F.coalesce("__same", F.lit(1).cast("long")),
        }
    )


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(
        docs.select(F.col(id_col).alias("__id"), F.unhex(text_sha256(docs, text_col)).alias("__sha")), "hashes"
    )


def duplicate_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS
) -> DataFrame:
    """One row for each row of `docs`: its id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs, id_col, text_col)
    groups, words, bits, total = _groups(keys, most_bits)
    rows = _assigned(keys, groups, words, bits, total)
    first = F.col("__id").eqNullSafe(F.col("keep_id"))
    columns = [F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256")]
    plain = rows.where(~first | (F.col("__same") == 1)).withColumn("kept", first).select(*columns)
    if groups.where("__same > 1").isEmpty():
        return plain
    # Rows equal in id and text can't be told apart: counted, one of each stays.
    same = rows.where(first & (F.col("__same") > 1)).groupBy("__id", "__sha", "keep_id", "group_size")
    same = same.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    return plain.unionByName(same.withColumn("kept", F.col("k") == 1).select(*columns))


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns and no others.

    Whole rows shuffle only if the second filter has all bits of their text.
    """
    groups, words, bits, total = _groups(_keys(docs, id_col, text_col), most_bits)
    columns = [F.col(f"__row.`{x}`").alias(x) for x in docs.columns]
    rows = docs.select(
        F.struct(*map(quoted, docs.columns)).alias("__row"),
        F.col(id_col).alias("__id"),
        F.unhex(text_sha256(docs, text_col)).alias("__sha"),
    )
    rows = _assigned(rows, groups, words, bits, total).where(F.col("__id").eqNullSafe(F.col("keep_id")))
    alone = rows.where("__same = 1").select(*columns)
    if groups.where("__same > 1").isEmpty():
        return alone
    same = rows.where("__same > 1").groupBy("__sha").agg(F.first("__row").alias("__row"))
    return alone.unionByName(same.select(*columns))
