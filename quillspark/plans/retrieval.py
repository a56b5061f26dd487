"""Dense, lexical and hybrid retrieval over embeddings, documents and the benchmark.

Query set of the dense plans: every vector whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..operators import answer as A
from ..operators import cells, dense, fusion, lexical, segments
from ..operators import models as M
from ..storage import shared_folder
from .registry import query, table
from .statutes import strip_sql
from .texts import TOKENS


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("law"), "embedding")


def vector_queries(spark, sf_dir):
    return points(spark, sf_dir).where(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "qid")


def doc_chunks(spark, sf_dir):
    """Documents as chunks: the source is the law, the first line the title."""
    docs = table(spark, sf_dir, "documents")
    first = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    article = F.concat(F.lit("제"), (F.col("doc_id") % 97 + 1).cast("string"), F.lit("조"))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law"), first.alias("title"), F.coalesce("text", F.lit("")).alias("text"), article.alias("article"), F.left(first, F.lit(20)).alias("article_title"))


def text_queries(spark, sf_dir):
    """Benchmark items as questions; each names the law that its number falls on."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("law"), F.col("text").alias("query"))


DENSE = """dense_all AS (SELECT q.vec_id AS qid, p.vec_id AS chunk_id, p.label AS law, q.label AS q_law, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 {0}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS dense_rank FROM dense_all) WHERE dense_rank <= {1})"""


def dense_sql(where: str, k: int) -> str:
    return f"WITH {DENSE.format(where, k)} SELECT qid, dense_rank::INT AS dense_rank, chunk_id, law, round(score, 6) AS score FROM dense"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("R01_R04_J01_W07_dense_top_k", dense_sql("", 5))
def dense_top_k(spark, sf_dir):
    return rounded(dense.dense_top_k(vector_queries(spark, sf_dir), points(spark, sf_dir), 5, by_law=False), "score")


@query("R02_R03_F01_W01_dense_by_law", dense_sql("AND q.label = p.label AND q.vec_id <> p.vec_id", 5))
def dense_by_law(spark, sf_dir):
    return rounded(dense.dense_top_k(vector_queries(spark, sf_dir), points(spark, sf_dir), 5, by_law=True, exclude_self=True), "score")


def stored_cells(spark, sf_dir, n: int = 16):
    return cells.build(spark, shared_folder(spark, "cells"), points(spark, sf_dir), n)


@query("R01_R04_stored_cells", dense_sql("", 5))
def stored_cells_search(spark, sf_dir):
    """Probes until no cell left can hold a hit: the rows of the exact search."""
    found = cells.search(spark, stored_cells(spark, sf_dir), vector_queries(spark, sf_dir), 5, by_law=False, certified=True)
    return rounded(found.hits, "score")


@query("R02_F01_S10_stored_cells_by_law", dense_sql("AND q.label = p.label AND q.vec_id <> p.vec_id", 5))
def stored_cells_by_law(spark, sf_dir):
    found = cells.search(spark, stored_cells(spark, sf_dir), vector_queries(spark, sf_dir), 5, by_law=True, certified=True, exclude_self=True)
    return rounded(found.hits, "score")


def bm25_sql(by_law: bool, k: int, ctes_only: bool = False) -> str:
    scope, same = ("law", "AND q.law = c.law") if by_law else ("'*'", "")
    ctes = f"""
tok AS (SELECT doc_id AS chunk_id, source AS law, {TOKENS.format("coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')")} AS terms FROM documents),
posts AS (SELECT chunk_id, law, {scope} AS scope, len(terms) AS dl, unnest(terms) AS term FROM tok),
stats AS (SELECT {scope} AS scope, count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM tok GROUP BY 1),
dfs AS (SELECT scope, term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts JOIN stats USING (scope) GROUP BY scope, term, n, avgdl),
weights AS (SELECT scope, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY scope) ELSE raw END AS idf FROM dfs),
q AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS law, text FROM benchmark),
qt AS (SELECT qid, {"law" if by_law else "'*'"} AS scope, unnest({TOKENS.format("coalesce(text, chr(32))")}) AS term FROM q),
scored AS (SELECT qid, chunk_id, sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN weights USING (scope, term) JOIN posts USING (scope, term) GROUP BY qid, chunk_id),
lex_all AS (SELECT a.qid, c.chunk_id, c.law, coalesce(s, 0) AS bm25_score FROM (SELECT DISTINCT qid FROM qt) a JOIN q USING (qid) JOIN tok c ON true {same} LEFT JOIN scored USING (qid, chunk_id)),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25_score, 9) DESC, chunk_id) AS rank FROM lex_all) WHERE rank <= {k})"""
    return ctes if ctes_only else f"WITH {ctes.strip()} SELECT qid, rank::INT AS rank, round(bm25_score, 6) AS bm25_score, chunk_id, law FROM lex"


@query("R06_R07_J02_bm25_top_k", bm25_sql(False, 50))
def bm25_top_k(spark, sf_dir):
    return rounded(lexical.bm25_top_k(text_queries(spark, sf_dir), doc_chunks(spark, sf_dir), 50), "bm25_score")


@query("R07_bm25_by_law", bm25_sql(True, 20))
def bm25_by_law(spark, sf_dir):
    return rounded(lexical.bm25_top_k(text_queries(spark, sf_dir), doc_chunks(spark, sf_dir), 20, by_law=True), "bm25_score")


def stored_index(spark, sf_dir, parts: int = 3):
    """The documents as a stored index of three segments, appended one after another."""
    path, chunks = shared_folder(spark, "segments"), doc_chunks(spark, sf_dir)
    for k in range(parts):
        index = segments.append(spark, path, chunks.where(F.col("chunk_id") % parts == k))
    return index


@query("R06_R07_stored_segments", bm25_sql(False, 20))
def stored_segments(spark, sf_dir):
    return rounded(segments.search(spark, stored_index(spark, sf_dir), text_queries(spark, sf_dir), 20), "bm25_score")


@query("R06_R07_stored_segments_by_law", bm25_sql(True, 20))
def stored_segments_by_law(spark, sf_dir):
    return rounded(segments.search(spark, stored_index(spark, sf_dir), text_queries(spark, sf_dir), 20, by_law=True), "bm25_score")


@query("R06_term_weights", f"WITH {bm25_sql(False, 1, True).strip()} SELECT term, round(idf, 6) AS idf FROM weights")
def term_weights(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    posts = lexical.postings(chunks)
    return rounded(lexical.term_weights(posts, lexical.corpus_stats(chunks, posts)).select("term", "idf"), "idf")


def hybrid_inputs(spark, sf_dir):
    """Benchmark questions with the vector of the same number; vectors stand for the documents of their number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    q = text_queries(spark, sf_dir).join(vectors, "qid")
    p = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").select(F.col("vec_id").alias("chunk_id"), F.col("source").alias("law"), "embedding")
    return q, p


HYBRID = """vq AS (SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON item_id = vec_id),
vp AS (SELECT vec_id AS chunk_id, source AS law, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
dall AS (SELECT qid, chunk_id, vp.law, list_cosine_similarity(vq.embedding::DOUBLE[], vp.embedding::DOUBLE[]) AS score FROM vq, vp),
dns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS dense_rank FROM dall) WHERE dense_rank <= 50),
lexq AS (SELECT lex.* FROM lex JOIN vq USING (qid)),
fused AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, coalesce(d.law, l.law) AS law, coalesce(1.0 / (5 + dense_rank), 0) + coalesce(1.0 / (5 + rank), 0) AS rrf_score, score AS dense_score, bm25_score, dense_rank, rank AS bm25_rank
  FROM dns d FULL OUTER JOIN lexq l ON d.qid = l.qid AND d.chunk_id = l.chunk_id),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM fused) WHERE rank <= {})"""


@query("R08_R09_J03_hybrid_rrf", f"WITH {bm25_sql(False, 50, True).strip()},\n{HYBRID.format(5)} SELECT qid, rank::INT AS rank, round(rrf_score, 6)::DOUBLE AS rrf_score, chunk_id, law, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank FROM hyb")
def hybrid_rrf(spark, sf_dir):
    q, p = hybrid_inputs(spark, sf_dir)
    return rounded(fusion.hybrid_search(q, p, doc_chunks(spark, sf_dir), 5, by_law=False), "rrf_score", "dense_score", "bm25_score")


@query("R10_J04_passages", "SELECT doc_id AS chunk_id, '[제' || (doc_id % 97 + 1) || '조' || CASE WHEN left(string_split(coalesce(text, ''), chr(10))[1], 20) <> '' THEN ' ' || left(string_split(text, chr(10))[1], 20) ELSE '' END || '] ' || coalesce(text, '') AS passage FROM documents UNION ALL SELECT -vec_id, '' FROM embeddings WHERE vec_id > 0")
def passages(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    wanted = chunks.select("chunk_id").unionByName(table(spark, sf_dir, "embeddings").where("vec_id > 0").select((-F.col("vec_id")).alias("chunk_id")))
    return A.attach_texts(wanted, chunks).select("chunk_id", "passage")


def _reranked(spark, sf_dir):
    queries = text_queries(spark, sf_dir)
    hits = lexical.bm25_top_k(queries, doc_chunks(spark, sf_dir), 20)
    hits = A.attach_texts(hits.select("qid", "rank", "bm25_score", "chunk_id", "law"), doc_chunks(spark, sf_dir))
    return A.rerank(hits.join(queries.select("qid", "query"), "qid"))


RERANK = f"""pairs AS (SELECT lex.qid, lex.rank, lex.chunk_id, {TOKENS.format("coalesce(q.text, chr(32))")} AS qs, {TOKENS.format("'제' || (doc_id % 97 + 1) || '조 ' || left(string_split(coalesce(d.text, ''), chr(10))[1], 20) || ' ' || coalesce(d.text, '')")} AS ps FROM lex JOIN q USING (qid) JOIN documents d ON d.doc_id = lex.chunk_id),
rer AS (SELECT *, len(list_intersect(qs, ps)) / len(qs) AS rerank_score FROM pairs),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rer) WHERE rerank_rank <= 5)"""


@query("R11_rerank", f"WITH {bm25_sql(False, 20, True).strip()},\n{RERANK} SELECT qid, rank::INT AS previous_rank, chunk_id, round(rerank_score, 6)::DOUBLE AS rerank_score, rerank_rank::INT AS rerank_rank FROM reranked")
def rerank(spark, sf_dir):
    return rounded(_reranked(spark, sf_dir).select("qid", "previous_rank", "chunk_id", "rerank_score", "rerank_rank"), "rerank_score")


#: Words lie between the characters that the SQL's ``\\s`` has: a no-break space is part of a word.
_WORD = re.compile(r"[^\t\n\f\r ]+")


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding model: signed hashed words, 64 dimensions, unit length.

    Words whose signs cancel out leave no direction: such a text gets that of its own hash. One
    without words is zero.
    """
    out = []
    for text in texts:
        v = np.zeros(64, np.float32)
        words = _WORD.findall((text or "").lower())
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        if words and not v.any():
            v[zlib.crc32(" ".join(words).encode()) % 64] = 1
        out.append(v / (np.linalg.norm(v) or 1))
    return pd.Series(out)


MODEL = {"words": 0.75, "pairs": 0.25}


def pair_scorer(spark):
    """The stand-in model, shipped to the workers."""
    folder = shared_folder(spark, "model")
    name = M.ship(spark, folder, folder.rsplit("/", 1)[1] + ".json", json.dumps(MODEL).encode())
    return name, M.OverlapModel.load


_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
MODEL_RERANK = f"""texts AS (SELECT lex.qid, lex.rank, lex.chunk_id, {_WORDS.format("q.text")} AS qw, {_WORDS.format("'[제' || (doc_id % 97 + 1) || '조' || CASE WHEN left(string_split(coalesce(d.text, ''), chr(10))[1], 20) <> '' THEN ' ' || left(string_split(d.text, chr(10))[1], 20) ELSE '' END || '] ' || coalesce(d.text, '')")} AS pw FROM lex JOIN q USING (qid) JOIN documents d ON d.doc_id = lex.chunk_id),
shares AS (SELECT *, CASE WHEN len(qw) > 0 THEN len(list_intersect(list_distinct(qw), pw)) / len(list_distinct(qw)) ELSE 0 END AS words, CASE WHEN len(qw) > 1 THEN len(list_intersect({_PAIRS.format("qw")}, {_PAIRS.format("pw")})) / len({_PAIRS.format("qw")}) ELSE 0 END AS pairs FROM texts),
again AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {MODEL["words"]}::DOUBLE * words + {MODEL["pairs"]}::DOUBLE * pairs DESC, rank) AS rerank_rank FROM shares)"""


@query("R11_A07_model_rerank", f"WITH {bm25_sql(False, 20, True).strip()},\n{MODEL_RERANK} SELECT qid, rank::INT AS previous_rank, chunk_id, round({MODEL['words']}::DOUBLE * words + {MODEL['pairs']}::DOUBLE * pairs, 6) AS rerank_score, rerank_rank::INT AS rerank_rank FROM again WHERE rerank_rank <= 5")
def model_rerank(spark, sf_dir):
    """The candidates scored by a model in the workers."""
    queries, chunks = text_queries(spark, sf_dir), doc_chunks(spark, sf_dir)
    hits = A.attach_texts(lexical.bm25_top_k(queries, chunks, 20).select("qid", "rank", "chunk_id", "law"), chunks)
    out = A.rerank(hits.join(queries.select("qid", "query"), "qid"), 5, M.scorer(*pair_scorer(spark)))
    return rounded(out.select("qid", "previous_rank", "chunk_id", "rerank_score", "rerank_rank"), "rerank_score")


@query("R12_embed", r"SELECT doc_id AS chunk_id, 64::INT AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def embed(spark, sf_dir):
    vectors = dense.embed(doc_chunks(spark, sf_dir).select("chunk_id", "text"), hashed_embedding)
    return vectors.select("chunk_id", F.size("embedding").alias("dim"), F.round(dense.norm(F.col("embedding")), 4).alias("norm"))


@query("R13_counts_by_law", "SELECT coalesce(source, 'MISSING') AS law, count(*) AS n FROM documents GROUP BY 1")
def counts_by_law(spark, sf_dir):
    from ..operators.index import counts_by_law as counts

    return counts(doc_chunks(spark, sf_dir))


def rag_questions(spark, sf_dir):
    q, p = hybrid_inputs(spark, sf_dir)
    return q, p


_CTX = "WITH {}, docs_of AS (SELECT dns.qid, dense_rank, dns.law, '제' || (doc_id % 97 + 1) || '조' AS article, left(string_split(coalesce(d.text, ''), chr(10))[1], 20) AS article_title, coalesce(d.text, '') AS text FROM dns JOIN documents d ON d.doc_id = dns.chunk_id WHERE dense_rank <= {})"
_DNS = HYBRID.split("lexq AS")[0].rstrip().rstrip(",")


@query("A01_A03_context", _CTX.format(_DNS, 5) + """ SELECT qid, string_agg('[' || dense_rank || '] ' || law || ' ' || article || CASE WHEN article_title <> '' THEN '(' || article_title || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY dense_rank) AS context, string_agg(law || ' ' || article, '|' ORDER BY dense_rank) AS sources, count(*)::INT AS n_docs FROM docs_of GROUP BY qid""")
def context(spark, sf_dir):
    q, p = rag_questions(spark, sf_dir)
    hits = dense.dense_top_k(q, p, 5, by_law=False).withColumnRenamed("dense_rank", "rank")
    out = A.build_context(A.attach_texts(hits, doc_chunks(spark, sf_dir)), q)
    return out.withColumn("sources", F.array_join("sources", "|"))


@query("A02_context_old", _CTX.format(_DNS, 3) + """ SELECT qid, string_agg('[' || dense_rank || '] ' || coalesce(law, '관련 법률') || ' ' || article || chr(10) || text, chr(10) || chr(10) ORDER BY dense_rank) AS context FROM docs_of GROUP BY qid""")
def context_old(spark, sf_dir):
    q, p = rag_questions(spark, sf_dir)
    hits = dense.dense_top_k(q, p, 3, by_law=False).withColumnRenamed("dense_rank", "rank")
    return A.build_context(A.attach_texts(hits, doc_chunks(spark, sf_dir)), q, with_title=False, default_law="관련 법률", top_k=3).select("qid", "context")


_PROMPTS = {"new": A.PROMPT, "old": A.PROMPT_OLD, "bare": A.PROMPT_BARE}


@query("A04_prompt", "SELECT doc_id, form, replace(replace(template, '{context}', coalesce(text, '')), '{question}', source) AS prompt FROM documents, (VALUES " + ", ".join(f"('{k}', '" + v.replace("'", "''") + "')" for k, v in _PROMPTS.items()) + ") f(form, template)")
def prompt(spark, sf_dir):
    """Each text as the context of each template."""
    chunks = doc_chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), "law", "text")
    prompts = F.array(*(F.struct(F.lit(k).alias("form"), A.prompt(F.col("text"), F.col("law"), v).alias("prompt")) for k, v in _PROMPTS.items()))
    return chunks.select("doc_id", F.inline(prompts))


_PASSAGE = "'제' || (doc_id % 97 + 1) || '조 ' || article_title || ' ' || text"
RAG_QUESTIONS = "vq AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS q_law, b.text AS query, embedding FROM benchmark b JOIN embeddings ON item_id = vec_id)"
RAG_STEPS = f"""vp AS (SELECT vec_id AS chunk_id, source AS law, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
rall AS (SELECT qid, chunk_id, law, query, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(vq.embedding::DOUBLE[], vp.embedding::DOUBLE[]) DESC, chunk_id) AS rank FROM vq JOIN vp ON law = q_law),
r20 AS (SELECT rall.*, doc_id, left(string_split(coalesce(text, ''), chr(10))[1], 20) AS article_title, coalesce(text, '') AS text FROM rall JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
rsc AS (SELECT *, {TOKENS.format("coalesce(query, chr(32))")} AS qs, {TOKENS.format(_PASSAGE)} AS ps FROM r20),
rrr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(qs, ps)) / len(qs) DESC, rank) AS rerank_rank FROM rsc),
picks AS (SELECT 'dense' AS mode, rank AS r, * FROM rrr WHERE rank <= 5 UNION ALL SELECT 'reranker', rerank_rank, * FROM rrr WHERE rerank_rank <= 5),
ctx AS (SELECT mode, qid, string_agg('[' || r || '] ' || law || ' 제' || (doc_id % 97 + 1) || '조' || CASE WHEN article_title <> '' THEN '(' || article_title || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS context,
  string_agg(law || ' 제' || (doc_id % 97 + 1) || '조', '|' ORDER BY r) AS sources, string_agg(r || ':' || doc_id || ':' || rank, '|' ORDER BY r) AS docs, list(doc_id ORDER BY r) AS doc_ids, count(*)::INT AS n_docs FROM picks GROUP BY mode, qid),
rag AS (SELECT vq.qid, query, q_law AS law, m.mode, coalesce(docs, '') AS docs, doc_ids, coalesce(context, '{A.NO_CONTEXT}') AS context, coalesce(sources, '') AS sources, coalesce(n_docs, 0)::INT AS n_docs,
  CASE WHEN context IS NOT NULL AND {strip_sql("left(substr(context, instr(context, chr(10)) + 1), 200)")} <> '' THEN {strip_sql("left(substr(context, instr(context, chr(10)) + 1), 200)")} || ' (' || left(context, instr(context, chr(10)) - 1) || ')' ELSE '{A.REFUSAL}' END AS answer FROM vq CROSS JOIN (VALUES ('dense'), ('reranker')) m(mode) LEFT JOIN ctx ON ctx.qid = vq.qid AND ctx.mode = m.mode)"""


RAG = RAG_QUESTIONS + ",\n" + RAG_STEPS


def listed(docs):
    """rank:chunk_id:dense_rank of each document of an answer."""
    return F.array_join(F.transform(docs, lambda d: F.concat_ws(":", d["rank"], d["chunk_id"], d["dense_rank"])), "|")


@query("A05_A06_A07_run_rag", f"WITH {RAG} SELECT * EXCLUDE (doc_ids) FROM rag")
def run_rag(spark, sf_dir):
    q, p = rag_questions(spark, sf_dir)
    chunks = doc_chunks(spark, sf_dir)
    out = A.run_rag(q, p, chunks).unionByName(A.run_rag(q, p, chunks, use_reranker=True))
    return out.withColumns({"sources": F.array_join("sources", "|"), "docs": listed(F.col("docs"))})
