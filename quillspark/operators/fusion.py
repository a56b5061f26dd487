"""Reciprocal rank fusion of rank lists, and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import dense_top_k
from .lexical import Index, build_index, search

RRF_K = 5


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, top_k: int = 5, k: int = RRF_K) -> DataFrame:
    """Full outer join of (qid, dense_rank, chunk_id, law, score) and (qid, rank, chunk_id, law, bm25_score).

    The fused score is the sum of 1 / (k + rank); ties go by dense rank, then BM25 rank. A
    hit's law is that of the dense list where both have it.
    """
    d = dense.select("qid", "chunk_id", F.col("law").alias("d_law"), "dense_rank", F.col("score").alias("dense_score"))
    b = lexical.select("qid", "chunk_id", F.col("law").alias("b_law"), F.col("rank").alias("bm25_rank"), "bm25_score")
    both = d.join(b, ["qid", "chunk_id"], "full_outer")
    gain = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", gain("dense_rank") + gain("bm25_rank")).withColumn("law", F.coalesce("d_law", "b_law"))
    best = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "rrf_score", "chunk_id", "law", "dense_score", "bm25_score", "dense_rank", "bm25_rank")


def hybrid_search(queries: DataFrame, points: DataFrame, chunks: DataFrame | Index, top_k: int = 5, candidates: int = 50, k: int = RRF_K, by_law: bool = False) -> DataFrame:
    """Dense and lexical candidates, fused. ``queries``: qid, law, query, embedding.

    ``chunks``: chunks, or an index of them (of ``by_law``'s kind) that several searches share.
    """
    index = chunks if isinstance(chunks, Index) else build_index(chunks, by_law)
    if index.by_law != by_law:
        raise ValueError("the index has the statistics of another kind of search")
    dense = dense_top_k(queries, points, candidates, by_law=by_law)
    return reciprocal_rank_fusion(dense, search(index, queries, candidates), top_k, k)
