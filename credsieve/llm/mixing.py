"""Mixing sources to target weights.

Rows get hash-random keys and are ranged by key within their source; distributed prefix sums of the
word counts find each source's cut, exact to the word: over 256 ranges of keys, then over the 256 parts
of the one range that holds the cut, and so on down to RANGE_ROWS rows, so no step orders more rows of
a source than that, however many it has.  Whole epochs repeat before the cut.  As keys decide, each row's share
follows from its source's cut alone: texts never shuffle.

Sources in order of code points, null last, weigh 5, 2, 1, repeating, and share `share` times all
words; a target stops at `most` times its source's words and the excess is shared by weight among the
others until none is above.  A target is rounded to whole words.  Rows that repeat an id share their
key, and where the cut falls on them, its words in proportion to their sizes (rounded down).

Null texts have no words; a source without words has target zero.  A null id is a key like any other.
An empty table gives no rows.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import SPACES, WORD, hot_rows, lookup, plain_text, quoted, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Rows of a range of keys that are put in order at once, and digits of the key by which ranges are split (256 parts).
RANGE_ROWS, DIGITS = 256, 2
#: Sources up to which the table of cuts (about 100 bytes each) is broadcast, and rows of a part when they are ranked.
FEW_SOURCES = 50_000


def _source_key(source_col: str):
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _key(id_col: str, seed: str):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def _ranked(sources: DataFrame) -> DataFrame:
    """`sources` with their place (from 0) by code point, null last: ranges, then places within each."""
    name = F.col("__source").asc_nulls_last()
    parts = 1 + sources.count() // FEW_SOURCES
    dealt = stored(sources.repartitionByRange(parts, name).withColumn("__part", F.spark_partition_id()), "sources")
    before, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in dealt.groupBy("__part").count().collect()):
        starts.append((part, before))
        before += n
    start = F.create_map(*(F.lit(x) for pair in starts for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    row = F.row_number().over(Window.partitionBy("__part").orderBy(name))
    return dealt.withColumn("__place", start[F.col("__part")] + row - 1).drop("__part")


def _targets(sources: DataFrame, weights: tuple, share: float, most: int) -> DataFrame:
    """`sources` (source_size) with target: the level of water in vessels as wide as the weights."""
    weight = F.element_at(F.array(*map(F.lit, map(int, weights))), (F.col("__place") % len(weights) + 1).cast("int"))
    sources = stored(_ranked(sources).withColumn("__weight", weight.cast("long")), "weights")
    top = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        before = level
        full = F.col("__weight") * F.lit(level) > top
        filled, open_weight = sources.agg(
            F.sum(F.when(full, top).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("__weight")))
        ).first()
        if open_weight:
            level = max(level, (share * total - filled) / open_weight)
    return sources.withColumn("target", F.least(F.col("__weight") * F.lit(level), top.cast("double")))


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, *more: str) -> DataFrame:
    return docs.select(
        *more,
        F.col(id_col),
        F.col(source_col).cast("string").alias("__source"),
        _source_key(source_col).alias("__s"),
        F.regexp_count(plain_text(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
        _key(id_col, seed).alias("__key"),
    )


def cuts(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source of the stored `rows`: __s, source_size, target, __epochs, __cut (key), __part and
    __group (words of the cut's rows that are taken, and all of them), n (rows)."""
    ranged = rows.withColumn("__range", F.substring("__key", 1, DIGITS))
    sums = stored(ranged.groupBy("__s", "__range").agg(F.sum("size").alias("words"), F.min("__source").alias("__source"), F.count(F.lit(1)).alias("n")), "ranges")
    sources = sums.groupBy("__s").agg(F.sum("words").alias("source_size"), F.min("__source").alias("__source"), F.sum("n").alias("n"))
    plan = _targets(sources, weights, share, most).withColumn("__budget", F.floor(F.col("target") + 0.5).cast("long"))
    plan = plan.withColumns(
        {
            "__epochs": F.expr("if(source_size = 0, 0L, __budget div source_size)"),
            "__rest": F.expr("if(source_size = 0, 0L, __budget % source_size)"),
        }
    )
    plan = stored(plan.select("__s", "source_size", "target", "__epochs", "__rest", "n"), "plan")
    few = plan.count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda x: x)

    def crossed(parts: DataFrame, order: str) -> DataFrame:
        """The part of each source in which its prefix sum passes what is left to take."""
        so_far = F.sum("words").over(Window.partitionBy("__s").orderBy(order)) - F.col("words")
        return parts.withColumn("__left", F.col("__rest") - so_far).where("__left >= 0 and __left < words")

    at = sums.select("__s", "__range", "words", "n").join(small(plan.select("__s", "__rest")), "__s")
    digits = DIGITS
    while True:
        at = crossed(at, "__range").select("__s", "__range", F.col("__left").alias("__rest"), F.col("n").alias("rows"))
        at = stored(at, "cut_ranges")
        here = rows.withColumn("__range", F.substring("__key", 1, digits)).join(small(at), ["__s", "__range"])
        if digits >= 32 or (at.agg(F.max("rows")).first()[0] or 0) <= RANGE_ROWS:
            break
        digits += DIGITS
        parts = here.withColumn("__range", F.substring("__key", 1, digits)).groupBy("__s", "__rest", "__range")
        at = parts.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    inside = here.groupBy("__s", "__rest", "__key").agg(F.sum("size").alias("words"))
    cut = crossed(inside, "__key").select(
        "__s", F.col("__key").alias("__cut"), F.col("__left").alias("__part"), F.col("words").alias("__group")
    )
    return stored(plan.join(cut, "__s", "left"), "cuts")


def _with_taken(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """`rows` (__s, __key, size) with source_size, target, __epochs and __extra (words of the last, partial epoch)."""
    if table.count() <= FEW_SOURCES:
        rows = rows.join(F.broadcast(table.drop("n")), "__s")
    else:
        rows = lookup(rows, table, "__s", F.col("n") >= hot_rows(total)).drop("n")
    extra = (
        F.when(F.col("__key") < F.col("__cut"), F.col("size"))
        .when(F.col("__key") == F.col("__cut"), F.expr("size * __part div __group"))
        .otherwise(F.lit(0).cast("long"))
    )
    return rows.withColumn("__extra", extra)


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of `docs`: id, size, source_size, target (its source's), taken (words, repeats counted)."""
    rows = stored(sized(docs, id_col, source_col, text_col, seed), "sizes")
    found = _with_taken(rows, cuts(rows, weights, share, most), rows.count())
    taken = F.col("__epochs") * F.col("size") + F.col("__extra")
    return found.select(id_col, "size", "source_size", "target", taken.alias("taken"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: one for each whole epoch, and one for the last, partial epoch,
    whose text at the cut is its first words."""
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), quoted(id_col), quoted(source_col), quoted(text_col))
    keyed = sized(whole, id_col, source_col, text_col, seed, "__row").drop(id_col)
    rows = stored(keyed.drop("__row"), "sizes")
    found = _with_taken(keyed, cuts(rows, weights, share, most), rows.count())
    copies = F.expr("__epochs + if(__extra > 0 or (size = 0 and __key < __cut), 1L, 0L)")
    each = found.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("__copy") > F.col("__epochs")) & (F.col("__extra") < F.col("size"))
    text = F.col("__row")[text_col]
    words = F.regexp_extract_all(text, F.lit(f"(?:{SPACES})?{WORD}"), F.lit(0))
    first = F.concat_ws("", F.slice(words, 1, F.greatest("__extra", F.lit(1)).cast("int")))
    columns = [F.col("__row").getField(x).alias(x) for x in docs.columns if x != text_col]
    return each.select(*columns, F.when(cut, first).otherwise(text).alias(text_col)).select(*map(quoted, docs.columns))
