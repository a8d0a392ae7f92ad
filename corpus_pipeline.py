"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before kept, written as Parquet and read again; all but the
last return the columns of `documents`.  Every stage takes (spark, docs, sf_dir).

1. toxicity: rows that the score rejects go; the model is fitted on labelled rows of its input.
2. exact dedup: of equal texts (white space aside) the row with the smallest id stays.
3. SimHash near-dedup: of each group of near-duplicates the row with the smallest id stays.
4. mixing: sources are mixed to their target weights; rows repeat once an epoch, and the row at a
   source's cut keeps its first words.
5. packing: pieces of at most 1024 tokens with their sequence and place.

SQL can't express stages 1, 3 and 5 (a fitted model, XXH64, a tokenizer), so there is none for run();
the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import exact_dedup, mixing, packing, simhash, toxicity
from credsieve.llm.common import quoted, stored
from credsieve.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says that label 1 is less likely than the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, learn=toxicity.fold("doc_id", 3) != 1)
    return toxicity.with_scores(docs, model).where(F.col("predicted") == 0).select(*map(quoted, docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix; n_chars follows the text where it was cut."""
    mix = mixing.mixed(docs)
    if "n_chars" not in docs.columns:
        return mix
    return mix.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "_"))
    return docs
