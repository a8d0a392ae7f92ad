"""Best-fit packing by patterns of lengths and non-negative least squares.

Texts become token ids with an end mark; longer ones are cut into pieces of `limit` (the first may be
shorter).  The histogram of lengths, at most `limit` numbers, goes to the driver: patterns of up to
four lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what the rounded patterns leave is packed best-fit
decreasing, again by lengths.  The plan's size is bounded by the patterns, not by the data.

Pieces then find their place without meeting: ranks within a length come from counts by range of a
hash plus a rank within the range, and each slot of a pattern takes an interval of ranks.  Only about
50 bytes a piece shuffle; texts and ids stay where the scan read them.

Null and empty texts give one piece that holds the end mark alone.  Repeated rows are packed as often
as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import plain_text, ship_package, stored
from credsieve.llm.tokens import encoder

LIMIT, END = 1024, 2
#: Pieces of a range of hashes, and the most ranges.
RANGE_PIECES, MOST_RANGES = 2_000, 4096
#: Rounds of the fit, and lengths that are enumerated at most (others are left to best fit).
ROUNDS, MOST_LENGTHS = 400, 4096


def pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """Each piece of each row: id, piece (from 0), start, length, ids_crc32 and (if wanted) ids, little-endian 32-bit.

    Runs beside the scan, in Arrow batches of bounded size.
    """
    ship_package(docs.sparkSession)
    mark = np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = tool.ids(text) + mark
                n, start = len(data) // 4, 0
                stop = n % limit or limit
                piece = 0
                while start < n:
                    part = data[4 * start : 4 * stop]
                    rows.append((k, piece, start, stop - start, zlib.crc32(part)))
                    if ids:
                        parts.append(part)
                    piece, start, stop = piece + 1, stop, stop + limit
            k, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            columns = [
                batch.column(0).take(pa.array(k, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), plain_text(docs, text_col).alias("text"))
    fields = [
        T.StructField(id_col, rows.schema[0].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    return rows.mapInArrow(work, T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids))


def enumerated(counts: dict[int, int], limit: int) -> list[tuple[int, ...]]:
    """Patterns of two to four of the lengths there are that fill a sequence to the last token.

    All pairs; threes and fours in fixed proportions around each length, so their number grows with
    the number of lengths only.
    """
    there = sorted(counts)[-MOST_LENGTHS:]
    found = {tuple(sorted((a, limit - a), reverse=True)) for a in there if limit - a in counts}
    for a in there:
        rest = limit - a
        for share in (0.5, 0.6, 0.7, 0.8, 0.9):
            b = round(rest * share)
            if b in counts and rest - b in counts:
                found.add(tuple(sorted((a, b, rest - b), reverse=True)))
        for share, inner in ((0.34, 0.5), (0.5, 0.5), (0.5, 0.7)):
            b = round(rest * share)
            c = round((rest - b) * inner)
            d = rest - b - c
            if b in counts and c in counts and d in counts:
                found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found)


def fitted(patterns: list[tuple[int, ...]], counts: dict[int, int], limit: int) -> np.ndarray:
    """Non-negative repeat counts that fit the histogram in least squares: projected accelerated gradient."""
    width = max(map(len, patterns))
    places = np.array([p + (0,) * (width - len(p)) for p in patterns])
    used = places > 0
    target = np.zeros(limit + 1)
    target[list(counts)] = list(counts.values())

    def made(x: np.ndarray) -> np.ndarray:
        return np.bincount(places.ravel(), (x[:, None] * used).ravel(), limit + 1)

    def felt(r: np.ndarray) -> np.ndarray:
        return (r[places] * used).sum(axis=1)

    probe = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue, for the step
        probe = felt(made(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(ROUNDS):
        stepped = np.maximum(0, y - felt(made(y) - target) / (1.05 * norm))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = stepped, stepped + (before - 1) / t * (stepped - x)
    return x


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths, how often), all bins of like content at once."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            # Best fit fills the fullest bin again while it has room.
            for content in list(open_bins[room]):
                if not n:
                    break
                fit = room // length
                bins = min(open_bins[room][content], n // fit)
                if bins:
                    _move(open_bins, room, content, bins, (length,) * fit)
                    n -= bins * fit
                if n and open_bins[room].get(content) and n < fit:
                    _move(open_bins, room, content, 1, (length,) * n)
                    n = 0
            if not n:
                break
        fit = limit // length
        if n // fit:
            open_bins[limit - fit * length][(length,) * fit] = n // fit
        if n % fit:
            open_bins[limit - n % fit * length][(length,) * (n % fit)] = 1
    return [(content, n) for room in sorted(open_bins) for content, n in open_bins[room].items() if n]


def _move(open_bins: dict, room: int, content: tuple, bins: int, more: tuple) -> None:
    open_bins[room][content] -= bins
    if not open_bins[room][content]:
        del open_bins[room][content]
    target, new = open_bins[room - sum(more)], content + more
    target[new] = target.get(new, 0) + bins


def planned(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how often each is used; every counted length is used up."""
    left = {k: n for k, n in counts.items() if n and k < limit}
    plan = [((limit,), counts[limit])] if counts.get(limit) else []
    if patterns := enumerated(left, limit):
        fit = fitted(patterns, left, limit)
        for k in np.argsort(-fit, kind="stable"):
            need = {a: patterns[k].count(a) for a in patterns[k]}
            times = min(int(fit[k]), *(left.get(a, 0) // m for a, m in need.items()))
            if times > 0:
                plan.append((patterns[k], times))
                for a, m in need.items():
                    left[a] -= m * times
    return plan + best_fit({k: n for k, n in left.items() if n}, limit)


def packed(rows: DataFrame, limit: int = LIMIT, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The stored `rows` (with length, 1 to `limit`) with sequence_id and offset.

    `order` names the columns that rank rows of one length; rows equal in them are interchangeable.
    """
    spark = rows.sparkSession
    total = rows.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_PIECES))
    dealt = rows.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(ranges)))
    sums = stored(dealt.groupBy("length", "__range").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}
    first, taken, slots = 0, defaultdict(int), []
    for pattern, times in planned(counts, limit):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + times, first, offset))
            taken[length] += times
            offset += length
        first += times
    table = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long") if slots else spark.createDataFrame([], "length long, low long, high long, first long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__range")) - F.col("n")
    starts = sums.select("length", "__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__range").orderBy(*order))
    ranked = dealt.join(starts.hint("merge"), ["length", "__range"]).withColumn("__rank", F.col("__before") + within - 1)
    placed = ranked.join(
        F.broadcast(table.withColumnRenamed("length", "__length")),
        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")),
    )
    return placed.select(*rows.columns, (F.col("first") + F.col("__rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of `docs` with its place: id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = stored(pieces(docs, path, limit, end, id_col, text_col, ids=False), "pieces")
    return packed(found, limit, (id_col, "piece"))
