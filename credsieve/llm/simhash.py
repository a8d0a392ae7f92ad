"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Every different fingerprint emits all variants within half the radius (itself and its 64 single-bit
flips for a radius of 2).  Two fingerprints within the radius share a variant; two that share one
are within the radius.  Variants shuffle; of the fingerprints that meet at one (65 at most, whatever
the data, as equal fingerprints are one) neighbours in order are linked, which joins them all
without emitting all pairs.  Links are deduplicated and verified by their differing bits.
Components come from repeated contraction: every node points to its smallest neighbour, pointers
are followed to their ends, the graph shrinks to those ends.  Each round is a stored table.

Fingerprint: A-Z lower-cased; words are runs of characters other than ASCII white space; shingles of
three words, repeats included, joined by a space (fewer words: the whole sequence); a bit is 1 if it
is set in over half of the shingles' XXH64 (seed 42).  Null and empty texts have fingerprint zero,
which is linked like any other.  An empty table gives no rows; null ids come last among a
component's ids.  Rows that repeat an id or a text are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import hot_rows, lookup, numbered, plain_text, quoted, ship_package, stored

SHINGLE, RADIUS, SEED, BLOCK = 3, 2, 42, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + BLOCK)].tolist(), last[k : k + BLOCK].tolist())],
            np.uint64,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """__id and __fp (signed 64-bit) of every row; runs beside the scan."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["__id", "__fp"]
            )

    rows = docs.select(F.col(id_col).alias("__id"), plain_text(docs, text_col).alias("text"))
    schema = T.StructType([T.StructField("__id", rows.schema[0].dataType), T.StructField("__fp", T.LongType())])
    return rows.mapInArrow(work, schema)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u < v) of different fingerprints `__fp` that join all those within `radius` bits."""
    if radius != 2:
        raise ValueError("the variants here are single flips, for a radius of 2")
    variant = F.when(F.col("k") == 64, F.col("__fp")).otherwise(
        F.col("__fp").bitwiseXOR(F.expr("shiftleft(1L, k)"))
    )
    # One shuffle of 16 bytes a variant, then neighbours in order at each.
    dealt = nodes.select("__fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).select(
        "__fp", variant.alias("variant")
    )
    before = F.expr("lag(__fp) over (partition by variant order by __fp)")
    met = dealt.select("__fp", before.alias("u")).where("u is not null").select("u", F.col("__fp").alias("v"))
    return met.where(F.expr(f"bit_count(u ^ v) <= {radius}")).distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """__fp and root (the smallest node that it reaches) of every node of the stored `edges`; None without edges."""
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "parents")
        while True:  # follow pointers to their ends
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = stored(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jumps")
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = parent.select(F.col("u").alias("__fp"), F.col("p").alias("root"))
        else:
            up = parent.select(F.col("u").alias("root"), "p")
            mapping = stored(
                mapping.join(up, "root", "left").select("__fp", F.coalesce("p", "root").alias("root")), "mapping"
            )
        a = parent.select("u", F.col("p").alias("pu"))
        b = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(a, "u").join(b, "v").where("pu != pv")
        edges = stored(edges.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    return mapping


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row for each row of `docs`: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _components(rows, radius).select("__fp", "n", "component_id")
    found = lookup(rows, named, "__fp", F.col("n") >= hot_rows(rows.count()))
    return found.select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One stored row for each fingerprint of `rows`: __fp, root, least (its smallest id), n (its rows) and component_id."""
    smallest = F.min("__id")
    nodes = stored(rows.groupBy("__fp").agg(smallest.alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    mapping = components(stored(links(nodes, radius), "links"))
    if mapping is None:
        named = nodes.withColumn("root", F.col("__fp")).withColumn("component_id", F.col("least"))
    else:
        rooted = stored(nodes.join(mapping, "__fp", "left").withColumn("root", F.coalesce("root", "__fp")), "rooted")
        roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(roots, "root")
    return stored(named.select("__fp", "root", "least", "n", "component_id"), "named")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: exactly one of each component, with the smallest id (null last); of rows with
    equal ids the one with the smallest fingerprint, then the smallest key.

    Rows get a key once, in a stored copy of `docs`; dropped keys go by an anti join, so the texts that stay
    shuffle once at most.
    """
    kept = docs.columns
    key, fp = (_unused(x, kept) for x in ("__row", "__fp"))
    docs = stored(_keyed(docs, text_col, key, fp), "keyed")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(fp).alias("__fp"), F.col(key).alias("__key"))
    named = _components(rows)
    at = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("__fp").alias("fp"), "n")
    best = named.groupBy("root").agg(F.min(at).alias("at")).select(F.col("at.fp").alias("__fp"), F.col("at.id").alias("__best"), "at.n")
    # Of the fingerprint that stays, the smallest key among the rows with the smallest id.
    stay = lookup(rows, best, "__fp", F.col("n") >= hot_rows(rows.count()))
    stay = stay.where(F.col("n").isNotNull() & F.col("__id").eqNullSafe(F.col("__best")))
    stay = stored(stay.groupBy("__fp").agg(F.min("__key").alias(key)).select(key), "stay")
    dropped = stored(rows.select(F.col("__key").alias(key)).join(stay, key, "left_anti"), "dropped")
    return docs.join(dropped, key, "left_anti").select(*map(quoted, kept))


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def _keyed(docs: DataFrame, text_col: str, key: str, fp: str) -> DataFrame:
    """`docs` with the fingerprint and a number of each row; rows stay where they are."""
    ship_package(docs.sparkSession)
    text = _unused("__plain", docs.columns)
    rows = docs.withColumn(text, plain_text(docs, text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], names=schema.names
            )

    return numbered(rows).mapInArrow(work, schema).withColumn(key, F.monotonically_increasing_id())
