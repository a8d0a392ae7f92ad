"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words.  Lines with equal sets are one class, which stands where
its first line stands (by id, then place in the text).  A class is removed if an earlier class has a
Jaccard similarity of `threshold` or more; of a class that stays, only the first line stays.  Lines
without words always stay.

The join: tokens are put in order from rare to frequent; two sets can only be similar if their
prefixes (the first n - ceil(threshold * n) + 1 tokens) share a token, their sizes are near (length
filter), enough tokens are left behind the first shared one (positional filter), and the 128
parities of their tokens differ in no more bits than their sets may differ in tokens.  Candidates
that pass, and that 256 further parities allow, are verified on their whole sets.  A token that occurs once can't be shared and is left out.

Groups of near copies would pass all filters with all their pairs.  So each class is first held
against the earliest class with the same smallest and largest hashes (three keys), which settles
nearly all of such a group in linear time; only classes that this leaves open look for partners in
the join, and find all.  Nothing is capped, so no match is lost.

Rarity comes from counts of hashed tokens over all lines (2**COUNT_BITS counters, which is what is
broadcast); any order gives the same result.  What shuffles for each token of a prefix is five
numbers, and the self-join reads one shuffle twice; which of two similar classes stands earlier is
asked for such pairs only.  Whole sets are read from the texts, of lines that a Bloom filter of the candidates' places
lets through (2**BLOOM_BITS bits at most; beyond, more sets shuffle, with the same result).  Tokens
are compared by 64-bit and classes by 128-bit hashes.

Null and empty texts have one empty line.  Rows equal in id and text are one document with one
result; null ids come last.  An empty table gives no rows.  Columns of the input named like a result
column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import hot_rows, lookup, plain_text, ship_package, stored, unstored

THRESHOLD, COUNT_BITS, BLOOM_BITS = 0.8, 24, 27
#: Classes a worker remembers, so that it gives out the tokens of a repeated line once.
REMEMBERED = 1 << 18
#: Bytes of text that are hashed at once, counters of a page, rows of numbers that are broadcast at most.
BLOCK, PAGE, FEW = 1 << 18, 1 << 14, 1 << 20

_MORE = ("q0", "q1", "q2", "q3")
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_SPACE, _NEWLINE = np.zeros(256, bool), 10
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, U)
    found[0] = 1
    return np.cumprod(found)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of `data` begins, and its 64-bit hash: a polynomial over its bytes, mixed."""
    global _UP, _DOWN
    starts, hashes, begin = [], [], 0
    while begin < len(data):
        stop = begin + BLOCK
        if stop < len(data):  # blocks end at white space
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
        block = np.frombuffer(data[begin:stop], np.uint8)
        if len(block) >= len(_UP):
            _UP, _DOWN = _powers(_BASE, len(block) + 1), _powers(pow(_BASE, -1, 1 << 64), len(block) + 1)
        edge = np.flatnonzero(np.diff(_SPACE[block], prepend=True, append=True))
        first, end = edge[::2], edge[1::2]
        sums = np.zeros(len(block) + 1, U)
        terms = np.add(block, U(1), out=sums[1:])
        terms *= _UP[: len(block)]
        np.cumsum(terms, out=terms)
        hashes.append(mixed((sums[end] - sums[first]) * _DOWN[first]))
        starts.append(first + begin)
        begin = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, U))


def _ordered(owner: np.ndarray, *keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The order by owner (under 2**20), then by keys (unsigned numbers and their bits; the last one by its upper bits
    where all fit into 64 bits, and else in full)."""
    packed, room = owner.astype(U) << U(44), 44
    for values, bits in keys:
        take = min(room, bits)
        room -= take
        packed |= (values >> U(bits - take)) << U(room)
    order = np.argsort(packed)
    tied = np.flatnonzero(packed[order[1:]] == packed[order[:-1]])
    last = keys[-1][0]
    if (last[order[tied + 1]] != last[order[tied]]).any():
        return np.lexsort((*(k for k, _ in reversed(keys)), owner))
    return order


def line_sets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of `data` with words: their places, where their tokens begin (and the end), and their sorted tokens."""
    at, found = hashed_words(data)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == _NEWLINE)
    line = np.searchsorted(breaks, at)
    new = np.diff(line, prepend=-1) != 0  # words come in order of lines
    places, owner = line[new], np.cumsum(new) - 1
    if len(places) >= 1 << 20:
        order = np.lexsort((found, owner))
    else:
        order = _ordered(owner, (found, 64))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[new], found[new]
    return places, np.searchsorted(owner, np.arange(len(places) + 1)), found


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def alone(n: np.ndarray, threshold: float) -> np.ndarray:
    """True where only an equal set can be similar to one of n tokens: one more token is too many."""
    return n < threshold * (n + 1) - 1e-9


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Lower-cased texts joined by line ends, about BLOCK bytes at a time, with the place of the first."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) <= BLOCK):
            size += len(texts[k]) + 1
            k += 1
        yield first, b"\n".join(texts[first:k]).lower()


def _counts(rows: DataFrame, bits: int) -> np.ndarray:
    """How often each hashed token occurs, in up to 255 steps of a logarithm; 1 means once."""
    width = min(PAGE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, data in _blocks(batch.column(0).cast(pa.binary()).to_pylist()):
                np.add.at(found, (hashed_words(data)[1] >> U(64 - bits)).astype(np.int64), np.uint32(1))
        pages = found.reshape(-1, width)
        there = np.flatnonzero(pages.any(axis=1))
        for k in range(0, len(there), 128):
            part = there[k : k + 128].tolist()
            data = [pa.compress(pages[p].tobytes(), "lz4", asbytes=True) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["page", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def level(total: np.ndarray) -> bytes:
            steps = np.floor(np.log2(np.maximum(total, 1)) * 8).astype(np.int64) - 6
            return np.where(total == 0, 0, np.where(total == 1, 1, np.clip(steps, 2, 255))).astype(np.uint8).tobytes()

        def out(page: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([level(total)], pa.binary())], names=["page", "data"])

        page, total = None, None
        for batch in batches:  # in order of pages
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != page:
                    if page is not None:
                        yield out(page, total)
                    page, total = k, 0
                total = total + np.frombuffer(pa.decompress(data, 4 * width, "lz4"), np.uint32).astype(np.int64)
        if page is not None:
            yield out(page, total)

    # What a task finds is compressed by pages of counters, so a task sends about a byte for each counter that it has.
    pages = rows.select("__text").mapInArrow(count, "page int, data binary")
    levels = pages.repartition("page").sortWithinPartitions("page").mapInArrow(summed, "page int, data binary")
    table = np.zeros(1 << bits, np.uint8)
    for page, data in levels.collect():
        table[page * len(data) : (page + 1) * len(data)] = np.frombuffer(data, np.uint8)
    return table


def _lines(rows: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Each line with words: __id, __doc, line, c0 and c1 (its class); the first of a class in a worker also has n (its
    tokens), p0 and p1 (parities), q0 to q3 (more of them), k0 to k2 (keys), lone (how many tokens occur once; they come
    first) and prefix (the tokens from place `lone` on)."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, set()
        shift = U(64 - int(math.log2(len(table))))
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for first, data in _blocks(texts):
                lines, at, found = line_sets(data)
                if not len(lines):
                    continue
                begin, n = at[:-1], np.diff(at)
                c0, c1 = np.add.reduceat(found, begin), np.add.reduceat(mixed(found ^ U(0x1234567)), begin)
                # The text of each line, and its place there.
                here = texts[first:]
                ends = np.cumsum([x.count(b"\n") + 1 for x in here[: _upto(here, data)]])
                doc = np.searchsorted(ends, lines, side="right")
                line = lines - np.concatenate(([0], ends))[doc]
                fresh = np.zeros(len(lines), bool)
                open_lines = np.flatnonzero(~alone(n, threshold))
                for k, name in zip(open_lines.tolist(), zip(c0[open_lines].tolist(), c1[open_lines].tolist(), strict=True), strict=True):
                    if name not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(name)
                        fresh[k] = True
                take = pa.array(first + doc, pa.int64())
                cells = [batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), *(pa.array(x.view(np.int64)) for x in (c0, c1))]
                yield pa.RecordBatch.from_arrays([*cells, *_payload(found, begin, n, fresh, table, shift, threshold)], names=schema.names)

    more = "n int, p0 long, p1 long, q0 long, q1 long, q2 long, q3 long, k0 long, k1 long, k2 long, lone int, prefix array<bigint>"
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("line int, c0 long, c1 long, " + more).fields])
    return rows.mapInArrow(work, schema)


def _upto(texts: list[bytes], data: bytes) -> int:
    """How many of `texts`, joined by line ends, make `data`."""
    size, k = -1, 0
    while size < len(data) and k < len(texts):
        size += len(texts[k]) + 1
        k += 1
    return max(k, 1)


def _payload(found: np.ndarray, begin: np.ndarray, n: np.ndarray, fresh: np.ndarray, table: np.ndarray, shift: np.uint64, threshold: float) -> list[pa.Array]:
    """n, p0 to q3, k0 to k2, lone and prefix of the lines that are `fresh`; null for others."""
    none = ~fresh
    bit = U(1) << (found & U(63))
    parts = [(found >> U(6)) & U(1) == k for k in (0, 1)] + [(found >> U(7)) & U(3) == k for k in range(4)]
    bits = [bit] * 2 + [U(1) << ((found >> U(9)) & U(63))] * 4  # of 128 bits each token has one, and of 256 others one
    parities = [np.bitwise_xor.reduceat(np.where(x, y, U(0)), begin) for x, y in zip(parts, bits, strict=True)]
    keys = []
    for turn in (0, 21, 42):
        turned = (found << U(turn)) | (found >> U(64 - turn)) if turn else found
        keys.append(mixed(np.minimum.reduceat(turned, begin) ^ mixed(np.maximum.reduceat(turned, begin))))
    kept = np.repeat(fresh, n)
    tokens, sizes = found[kept], n[fresh]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = table[(tokens >> shift).astype(np.int64)]
    wide = len(sizes) >= 1 << 20
    order = np.lexsort((tokens, rare, owner)) if wide else _ordered(owner, (rare.astype(U), 8), (tokens, 64))
    rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    once = rare[order] == 1
    use = (rank < np.repeat(prefix_size(sizes, threshold), sizes)) & ~once
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner[use], minlength=len(sizes)))))
    where = np.concatenate(([0], np.cumsum(fresh)))
    lone = np.zeros(len(n), np.int32)
    lone[fresh] = np.bincount(owner[once], minlength=len(sizes))
    lists = pa.array(ends[where].astype(np.int32), mask=np.concatenate((none, [False])))  # null where not fresh
    return [
        pa.array(n.astype(np.int32), mask=none),
        *(pa.array(x.view(np.int64), mask=none) for x in parities),
        *(pa.array(x.view(np.int64), mask=none) for x in keys),
        pa.array(lone, mask=none),
        pa.ListArray.from_arrays(lists, pa.array(tokens[order][use].view(np.int64))),
    ]


def _may_match(a: dict[str, Column], b: dict[str, Column], threshold: float, places: bool = True) -> Column:
    """Length, positional and parity filters; `a` and `b` have n, p0 and p1, and i, the place of their first shared token."""
    n, m = a["n"], b["n"]
    least = F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-9)  # tokens that similar sets share
    near = F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - F.lit(1e-9)
    if places:
        near = near & (F.least(n - a["i"], m - b["i"]) >= least)
    differ = F.bit_count(a["p0"].bitwiseXOR(b["p0"])) + F.bit_count(a["p1"].bitwiseXOR(b["p1"]))
    return near & (differ <= n + m - 2 * least)


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if its rows, of a few numbers each, are at most FEW; dealt by key otherwise."""
    return F.broadcast(df) if df.count() <= FEW else df


def _near_enough(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The stored `pairs` whose 256 further parities allow that they are similar."""
    marks = known.select("row", "n", *_MORE)
    needed = pairs.select("row").union(pairs.select(F.col("other").alias("row"))).distinct()
    marks = stored(marks.join(_few(needed), "row", "left_semi"), "marks")
    side = _few(marks)
    met = pairs.join(side, "row").join(side.select(F.col("row").alias("other"), *(F.col(x).alias(f"o_{x}") for x in ("n", *_MORE))), "other")
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"o_{x}"))) for x in _MORE), F.lit(0))
    most = (F.col("n") + F.col("o_n")) * F.lit(1 - 2 * threshold / (1 + threshold)) + F.lit(1e-9)
    found = stored(met.where(differ <= most).select("row", "other"), "near_enough")
    unstored(marks, pairs)
    return found


def _verified(pairs: DataFrame, heads: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Of each of the `pairs` of classes (row, other) whose whole sets are similar, the one that stands later."""
    needed = pairs.select("row").union(pairs.select("other")).distinct()
    places = stored(heads.join(_few(needed), "row").select("row", "__id", "__doc", "line"), "places")
    bits = 10
    while bits < BLOOM_BITS and 1 << bits < 16 * places.count():
        bits += 1
    # One place by document and line, one by document, so that most texts are passed over at once.
    at = [F.shiftrightunsigned(F.col("__doc").bitwiseXOR(F.shiftleft(F.col("line").cast("long"), 44)), 64 - bits), F.shiftrightunsigned(F.shiftleft("__doc", 20), 64 - bits)]
    words = places.select(F.explode(F.array(*at)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(max(1, 1 << bits >> 6), np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    docs = places.select("__doc").distinct()
    if docs.count() <= FEW:
        rows = rows.join(F.broadcast(docs), "__doc", "left_semi").select(*rows.columns)
    sent = rows.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little") if bits < 20 else table)

    def there(bit: np.ndarray) -> np.ndarray:
        table = sent.value
        if table.dtype == np.uint8:
            return table[bit.astype(np.int64)] == 1
        return (table[(bit >> U(6)).astype(np.int64)].view(U) >> (bit & U(63))) & U(1) == 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1).to_numpy().view(U)
            hit = np.flatnonzero(there((docs << U(20)) >> U(64 - bits)))
            texts = batch.column(2).take(pa.array(hit, pa.int64())).cast(pa.binary()).to_pylist()
            owner, line, asked = [], [], []
            for k, text in zip(hit.tolist(), texts, strict=True):
                lines = text.split(b"\n")
                key = docs[k] ^ (np.arange(len(lines), dtype=U) << U(44))
                for x in np.flatnonzero(there(key >> U(64 - bits))).tolist():
                    owner.append(k)
                    line.append(x)
                    asked.append(lines[x])
            sets, sizes = [np.zeros(0, U)], np.zeros(len(asked), np.int64)
            for first, data in _blocks(asked):
                at, begin, tokens = line_sets(data)
                sizes[first + at] = np.diff(begin)
                sets.append(tokens)
            take = pa.array(owner, pa.int64())
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), found], names=schema.names)

    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("line int, tokens array<bigint>").fields])
    here = rows.mapInArrow(work, schema).toDF("r_id", "r_doc", "r_line", "tokens")
    same = F.col("__id").eqNullSafe(F.col("r_id")) & (F.col("__doc") == F.col("r_doc")) & (F.col("line") == F.col("r_line"))
    at = F.struct(F.col("__id").isNull().alias("none"), "__id", "__doc", "line").alias("at")
    sets = stored(places.join(here, same).select("row", at, "tokens").dropDuplicates(["row"]), "sets")
    both = pairs.join(sets, "row").join(sets.select(F.col("row").alias("other"), F.col("at").alias("o_at"), F.col("tokens").alias("others")), "other")
    common = F.size(F.array_intersect("tokens", "others"))
    whole = F.size("tokens") + F.size("others") - common
    later = F.when(F.col("at") > F.col("o_at"), F.col("row")).otherwise(F.col("other")).alias("row")
    found = stored(both.where(common >= F.lit(threshold) * whole - F.lit(1e-9)).select(later).distinct(), "verified")
    unstored(sets, places)
    return found


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """__id, __doc and the places of the lines to remove, for documents that lose any."""
    ship_package(docs.sparkSession)
    text = plain_text(docs, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__doc"), text.alias("__text"))
    lines = stored(_lines(rows, _counts(rows, COUNT_BITS), threshold).withColumn("row", F.monotonically_increasing_id()), "lines")
    heads = lines.groupBy("c0", "c1").agg(
        F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__doc", "line")).alias("at"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(F.col("n").isNotNull(), F.col("row"))).alias("row"),
        F.count("n").alias("given"),
    )
    heads = stored(heads.select("c0", "c1", "at.__id", "at.__doc", "at.line", "rows", "row", "given"), "heads")
    # The tokens of a class: once, whatever the number of tasks that have met it.  Its name is the row that has them.
    repeated = heads.where("given > 1").select("c0", "c1", F.col("row").alias("own"))
    known = lines.where(F.col("n").isNotNull()).join(_few(repeated), ["c0", "c1"], "left").where("own is null or own = row")

    keyed = known.select("row", "n", "p0", "p1", F.explode(F.array("k0", "k1", "k2")).alias("key"))
    least = {x: F.min_by(x, "row").alias(f"b_{x}") for x in ("n", "p0", "p1")}  # of numbers, so these aggregate by hash
    leaders = keyed.groupBy("key").agg(F.min("row").alias("other"), *least.values(), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = keyed.join(leaders, "key").where(F.col("row") != F.col("other"))
    met = met.where(_may_match({x: F.col(x) for x in least}, {x: F.col(f"b_{x}") for x in least}, threshold, places=False))
    led = _near_enough(stored(met.select("row", "other").distinct(), "led"), known, threshold)
    settled = _verified(led, heads, rows, threshold)

    # One number holds n, the place and whether the class is still open, so that both sides of the join read one shuffle.
    marked = known.join(_few(settled.withColumn("settled", F.lit(1))), "row", "left")
    postings = marked.select("row", "n", "p0", "p1", "lone", F.col("settled").isNull().cast("long").alias("open"), F.posexplode("prefix").alias("i", "token"))
    place = F.shiftleft((F.col("i") + F.col("lone")).cast("long"), 1)
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(place).bitwiseOR(F.col("open"))
    postings = postings.select("token", "row", packed.alias("packed"), "p0", "p1")

    def side(name: str) -> dict[str, Column]:
        word = F.col(f"{name}.packed")
        return {"n": F.shiftright(word, 32).cast("int"), "i": F.shiftright(word.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int"), "p0": F.col(f"{name}.p0"), "p1": F.col(f"{name}.p1")}

    # Conditions on one side alone would be pushed below the shuffle, which is then no longer the same for both.
    once = (F.col("a.token") == F.col("b.token")) & (F.col("b.row") < F.col("a.row"))
    either = F.col("a.packed").bitwiseOR(F.col("b.packed")).bitwiseAND(F.lit(1)) == 1
    met = postings.alias("a").join(postings.alias("b").hint("merge"), once & either & _may_match(side("a"), side("b"), threshold))
    met = met.select(F.col("a.row").alias("row"), F.col("b.row").alias("other")).distinct()
    met = stored(met.join(led, ["row", "other"], "left_anti"), "met")
    met = _near_enough(met, known, threshold)
    unstored(led)
    gone = settled.union(_verified(met, heads, rows, threshold)).distinct().withColumn("gone", F.lit(True))
    unstored(met)
    marked = heads.join(_few(gone), "row", "left").where((F.col("rows") > 1) | F.col("gone"))
    marked = stored(marked.select("c0", "c1", F.col("__id").alias("h_id"), F.col("__doc").alias("h_doc"), F.col("line").alias("h_line"), "rows", F.coalesce("gone", F.lit(False)).alias("gone")), "marked")
    unstored(heads, settled)
    slim = lines.select("__id", "__doc", "line", "c0", "c1")
    found = lookup(slim, marked, ["c0", "c1"], F.col("rows") >= hot_rows(slim.count()))
    first = F.col("__id").eqNullSafe(F.col("h_id")) & (F.col("__doc") == F.col("h_doc")) & (F.col("line") == F.col("h_line"))
    found = found.where(F.col("rows").isNotNull() & (F.col("gone") | ~first)).groupBy("__id", "__doc").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    found = stored(found, "removed")
    unstored(lines, marked)
    return found


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the text that is left, and n_lines, n_removed and removed (places from 0, in order)."""
    gone = removed_lines(docs, id_col, text_col, threshold)
    size = gone.agg(F.sum(4 + F.size("removed"))).first()[0] or 0
    few = F.broadcast if size <= 4 * FEW else (lambda x: x)  # else texts shuffle to their lists
    gone = gone.select(F.col("__id").alias("__gone_id"), F.col("__doc").alias("__gone_doc"), "removed")
    text = plain_text(docs, text_col)
    here = docs.drop("n_lines", "n_removed", "removed")
    found = here.join(few(gone), F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_doc")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(F.col("removed"), k)), "\n")
    found = found.withColumns({"removed": removed, "n_lines": F.size(lines).cast("long"), "n_removed": F.size(removed).cast("long")})
    found = found.withColumn(text_col, F.when(F.size("removed") == 0, text).otherwise(left))
    return found.drop("__gone_id", "__gone_doc")
