"""What the operators of this subpackage share: text columns, shared storage and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.sources.shipping import ship_package

#: ASCII white space, and the complement: a word is a run of the latter.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE, HOT_ROWS = 0.001, 1000


__all__ = ["HOT_ROWS", "HOT_SHARE", "SPACES", "WORD", "hot_rows", "lookup", "numbered", "plain_text", "quoted", "shared_folder", "ship_package", "stored", "unstored"]


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """`df` with names that mapInArrow takes, whatever its columns are called."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def plain_text(df: DataFrame, name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where none is set, a temporary one in local mode, which has
    no other machines; elsewhere that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="credsieve-"))
    return sc.getCheckpointDir()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled within is removed from the executors' disks as soon as the query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def unstored(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more; others are left to the folder's expiry."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hot_rows(total: int) -> int:
    """Rows from which a key counts as hot, of `total` rows."""
    return max(HOT_ROWS, int(total * HOT_SHARE) + 1)


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], hot: Column) -> DataFrame:
    """`left` with the columns of its row of `right` (one row a key at most; null where none).

    `hot` marks the rows of `right` whose key has at least hot_rows() rows of `left`; as these are
    at most 1 / HOT_SHARE, they are broadcast, and the rows of a hot key stay where they are.  All
    other rows are dealt by key.  `left` is read twice: it should be a stored table.
    """
    few = right.where(hot).withColumn("__hot", F.lit(True))
    here = left.join(F.broadcast(few), key, "left").where(F.col("__hot")).drop("__hot")
    rest = left.join(F.broadcast(few.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.where(~hot), key, "left")
    return here.unionByName(rest)
