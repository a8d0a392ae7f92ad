"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import chat, exact_dedup, line_dedup, minhash, mixing, packing, quality, simhash, tokens, toxicity

#: Where the public tokenizer files are; a parameter of every operator that needs one.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(_table(spark, sf_dir, "documents"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024, end=2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels, learn=quality.fold("doc_id", 4) != 2, sample=6000)
    found = quality.scores(docs, machine, threshold=0.7)
    return found.select("doc_id", (quality.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat.read_back(chat.examples(rows.unionByName(more)), ordered=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_report(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeated_lines(_table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("left_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn=toxicity.fold("doc_id", 3) != 1, sample=3000)
    found = toxicity.scores(docs, model, threshold=0.7)
    return found.select("doc_id", (toxicity.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pattern_packing": op2_pattern_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mixing": op4_source_mixing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_token_counts": op6_token_counts,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    # The level at which k sources are full is the first that fills no more of them.
    "op4_source_mixing": r"""
        WITH rows AS (
            SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size) AS source_size,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM rows GROUP BY source
        ), ordered AS (
            SELECT *, row_number() OVER w AS k, 2.0 * source_size / weight AS full_at,
                   coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
                   1.5 * sum(source_size) OVER () AS total
            FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
        ), level AS (
            SELECT CAST(total - filled AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM ordered
            WHERE CAST(total - filled AS DOUBLE) / CAST(open_weight AS DOUBLE) <= full_at ORDER BY k LIMIT 1
        ), plan AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size,
                   least(weight * level, CAST(2 * source_size AS DOUBLE)) AS target,
                   CAST(floor(least(weight * level, CAST(2 * source_size AS DOUBLE)) + 0.5) AS BIGINT) AS budget
            FROM sources, level
        ), sums AS (
            SELECT r.doc_id, r.size, p.source_size, p.target,
                   CASE WHEN p.source_size = 0 THEN 0 ELSE p.budget // p.source_size END AS epochs,
                   CASE WHEN p.source_size = 0 THEN 0 ELSE p.budget % p.source_size END AS rest,
                   sum(r.size) OVER (PARTITION BY r.source, r.key) AS grp,
                   sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key RANGE UNBOUNDED PRECEDING) AS so_far
            FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + CASE WHEN so_far <= rest THEN size WHEN so_far - grp >= rest OR grp = 0 THEN 0
                    ELSE size * (rest - (so_far - grp)) // grp END AS BIGINT) AS taken
        FROM sums
    """,
}
