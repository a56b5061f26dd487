"""Queries op1 to op13 and the pipeline over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embeddings, licences, negatives, packing, pii, repair, simhash, topk, toxicity, warc, whitening
from .encoding import vocabulary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_read(spark, sf_dir, "conversations"))


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_digest(repair.token_files(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0))


def op3_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2))


def op4_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op5_warc_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_read(spark, sf_dir, "embeddings"))


def op7_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_read(spark, sf_dir, "documents"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_licence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_read(spark, sf_dir, "documents"))


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"), 5, 10, 30, 90)


def op12_block_matrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), 4)


def op13_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_prefix_targets, op2_repair_token_files, op3_online_packing, op4_simhash_bk_trees, op5_warc_seekable_zstd, op6_collision_projections, op7_toxicity_nb_ngrams, op8_pii_checksums, op9_template_decontamination, op10_licence_positions, op11_inverted_multi_index, op12_block_matrix_whitening, op13_segment_top_k)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
