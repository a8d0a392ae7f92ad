"""Document fingerprints: one-permutation MinHash, DataFrame functions only.

Each shingle (five lower-cased words; fewer: the whole sequence) is hashed once.  The hash's upper
part deals it to one of BINS bins, which keep their smallest hash; sorting the hashes once puts the
first of each bin in place.  An empty bin borrows from another by optimal densification: it tries
bins in a random order of its own, the same for every text, until one is not empty.  (The first
TRIES of the order are written out; the rest, needed by very short texts only, is the order of a
hash.)  Of each bin BITS low-order bits are stored, packed as hex digits.  Likeness is the share of
equal bins, corrected for the bins that agree by chance: (share - 2**-BITS) / (1 - 2**-BITS), 0 to 1.

Null and empty texts have no shingles; they share the fingerprint of the empty sequence and are
alike.  Equal texts have equal fingerprints.  Texts, neighbours and fingerprints of a row are
computed in one pass after one shuffle by ranges of ids; the first row of a range is sent to the
range before it as well, so no row is looked up and no range is a single task.  Rows that repeat an
id follow each other in the order of their texts; null ids come first.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import SPACES, plain_text

SHINGLE, BINS, BITS, TRIES = 5, 256, 8, 12
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1500, 1 << 14


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tries(bins: int, tries: int) -> list[Column]:
    """For each try, the bin (from 1) that every bin borrows from: a hash of bin and try, as expressions of the bin."""
    return [lambda i, k=k: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(bins)).cast("int") + 1 for k in range(tries)]


def signature(text: Column, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, tries: int = TRIES) -> Column:
    """The low-order bits of each bin, as an array of small integers; one value for texts without words."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda x: x != "")
    shift = 64 - (bins - 1).bit_length()

    def of_hashes(hashes: Column) -> Column:  # sorted
        first = F.filter(
            hashes,
            lambda h, k: (k == 0)
            | (F.shiftrightunsigned(h, shift) != F.shiftrightunsigned(F.get(hashes, k - 1), shift)),
        )
        return _let(
            F.map_from_entries(
                F.transform(first, lambda h: F.struct(F.shiftrightunsigned(h, shift).cast("int").alias("bin"), h.alias("hash")))
            ),
            of_bins,
        )

    def of_bins(found: Column) -> Column:
        there = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.element_at(found, i))
        return _let(there, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: low(filled(m, found, i))))

    def filled(m: Column, found: Column, i: Column) -> Column:
        rest = F.array_min(
            F.transform(F.map_entries(found), lambda e: F.struct(F.xxhash64(i, e["key"]).alias("order"), e["value"].alias("hash")))
        )["hash"]
        return F.coalesce(F.element_at(m, i + 1), *(F.element_at(m, place(i)) for place in _tries(bins, tries)), rest)

    def low(h: Column) -> Column:
        return h.bitwiseAND(F.lit((1 << bits) - 1)).cast("short")

    def of_words(w: Column) -> Column:
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        some = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle)))
        )
        return _let(F.sort_array(some), of_hashes)

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return _let(hashed, of_words)


def packed_hex(values: Column, bits: int = BITS) -> Column:
    """Values of 8 or 4 bits as hex digits."""
    digits = bits // 4
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), digits, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two signatures, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(bins))
    chance = 2.0**-bits
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with its fingerprint; no shuffle."""
    return docs.drop(name).withColumn(name, packed_hex(signature(plain_text(docs, text_col))))


def _ranges(docs: DataFrame, id_col: str) -> list:
    """The ids at which ranges begin; at most MOST_RANGES."""
    total, smallest = docs.agg(F.count(F.lit(1)), F.min(id_col)).first()
    parts = min(MOST_RANGES, total // RANGE_ROWS)
    if parts < 2:
        return []
    at = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    return sorted({x for x in at if x is not None and x > smallest})


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its fingerprint, that of its edited text (its last half replaced by the
    beginning of the next text in the order of ids; after the last row, the first), and both likenesses."""
    text = plain_text(docs, text_col)
    begins = _ranges(docs, id_col)
    own = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    group = 256  # a range is found in two steps of at most this many comparisons
    if begins:
        blocks = [begins[k : k + group] for k in range(0, len(begins), group)]
        heads = F.array(*(F.lit(b[0]) for b in blocks[1:])) if len(blocks) > 1 else None
        block = F.size(F.filter(heads, lambda x: x <= F.col("__id"))) if heads is not None else F.lit(0)
        inner = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.col("__block") + 1)
        own = own.withColumn("__block", F.coalesce(block, F.lit(0)))
        own = own.withColumn("__range", F.coalesce(F.col("__block") * group + F.size(F.filter(inner, lambda x: x <= F.col("__id"))), F.lit(0)))
        first_of_range = F.coalesce(F.array_contains(inner, F.col("__id")), F.lit(False))
    else:
        own = own.withColumn("__range", F.lit(0))
        first_of_range = F.lit(False)
    smallest = own.agg(F.min(F.struct(F.col("__id").isNotNull(), F.col("__id")))).first()[0]
    first_of_all = F.col("__id").eqNullSafe(F.lit(smallest[1] if smallest else None))
    # Where each row goes: to its range, and to the end of the range before if it is the first of its own.
    also = F.when(first_of_all, F.lit(len(begins))).when(first_of_range, F.col("__range") - 1)
    sent = own.select(
        "__id", "__text", F.explode(F.filter(F.array(F.struct(F.col("__range").alias("to"), F.lit(False).alias("guest")), F.struct(also.alias("to"), F.lit(True).alias("guest"))), lambda x: x["to"].isNotNull())).alias("__at")
    )
    sent = sent.select("__id", "__text", F.col("__at.to").alias("__range"), F.col("__at.guest").alias("__guest"))
    sent = sent.repartition("__range").withColumn("__signature", signature(F.col("__text")))
    order = Window.partitionBy("__range").orderBy("__guest", "__id", "__text")
    near = F.lead(F.struct("__text", "__signature")).over(order)
    rows = sent.withColumn("__next", near).where(~F.col("__guest"))
    n = F.char_length("__text")
    edited = F.concat(F.expr("substring(__text, 1, char_length(__text) - char_length(__text) div 2)"), F.expr("substring(__next.__text, 1, char_length(__text) div 2)"))
    rows = rows.withColumns({"__n": n.cast("long"), "__edited": edited})
    rows = rows.withColumn("__edited_signature", signature(F.col("__edited")))
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        packed_hex(F.col("__signature")).alias("fingerprint"),
        packed_hex(F.col("__edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("__signature"), F.col("__edited_signature")).alias("near_edited"),
        likeness(F.col("__signature"), F.col("__next.__signature")).alias("near_next"),
    )
