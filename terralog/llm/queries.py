"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.llm import oracles as sql
from terralog.llm.centroids import clustered
from terralog.llm.conversations import damaged, repair_digest, repaired
from terralog.llm.decontamination import contamination
from terralog.llm.exact_dedup import exact_dedup
from terralog.llm.hilbert import hilbert_shards
from terralog.llm.mixing import taken_words
from terralog.llm.packing import packed_pieces
from terralog.llm.quality import quality_scores
from terralog.llm.repair import token_file_digest
from terralog.llm.simhash import near_groups
from terralog.llm.suffix_dedup import repeated_bytes
from terralog.llm.token_counts import token_counts
from terralog.llm.toxicity import toxicity_scores


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package that holds them is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packed_pieces(_documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), 1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("bigint")).drop("ids")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(_documents(spark, folder))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_digest(_documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


def op5_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards(_documents(spark, folder), 40)


def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_documents(spark, folder), radius=2)


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_bytes(_documents(spark, folder))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("bigint")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(_documents(spark, folder), _labels(spark, folder), "toxic", 5, 0)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_scores(_documents(spark, folder).select("doc_id", "text"), _labels(spark, folder), "quality", 4, 2)
    return found.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_documents(spark, folder), tokenizer_path("piece_bpe_32k.model"), 4096)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_digest(repaired(damaged(spark.read.parquet(f"{folder}/conversations.parquet"))))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{folder}/embeddings.parquet"), k=8, rounds=10, size=64)


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(_documents(spark, folder))


_ALL = (
    op1_packing, op2_exact_dedup, op3_decontamination, op4_token_files, op5_hilbert_shards, op6_simhash_groups, op7_suffix_dedup, op8_toxicity, op9_quality, op10_token_counts,
    op11_conversation_repair, op12_centroid_clusters, op13_source_mix,
)

_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)
    """,
    "op3_decontamination": r"""
        WITH lowered AS (
            SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark
        ), worded AS (
            SELECT doc_id, item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'
            ) AS words FROM lowered
        ), sized AS (
            SELECT item_id, words, least(13, len(words)) AS size FROM worded WHERE item_id IS NOT NULL AND len(words) > 0
        ), phrases AS (
            SELECT DISTINCT item_id, size, array_to_string(words[p : p + size - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM sized)
        ), docs AS (
            SELECT doc_id, words FROM worded WHERE item_id IS NULL
        ), found AS (
            SELECT doc_id, p, size, item_id FROM (
                SELECT doc_id, p, size, array_to_string(words[p : p + size - 1], ' ') AS phrase FROM (
                    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
                    FROM docs, (SELECT DISTINCT size FROM phrases) WHERE len(words) >= size
                )
            ) JOIN phrases USING (size, phrase)
        ), hit AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_conversation_repair": sql.conversation_repair(),
    "op12_centroid_clusters": sql.centroid_clusters(),
    "op13_source_mix": sql.MIXES,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracles() -> dict[str, str]:
    return dict(_SQL)
