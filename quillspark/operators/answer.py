"""Re-ranking and answering with pluggable models: Arrow UDFs in, DataFrames out."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.tokens import tokenize
from ..storage import staged
from .dense import dense_top_k
from .models import timed_text

#: What stands for a missing context, and the refusal.
NO_CONTEXT = "검색된 관련 조문이 없습니다."
REFUSAL = "제공된 조문에서 해당 내용을 확인할 수 없습니다."
#: Templates of their own wording; any with {context} and {question} can be given. The rules: the
#: articles alone, nothing made up, the refusal, the sources named at the end, short but whole.
PROMPT = "[규칙]\n- 아래 조문만 근거로 답합니다.\n- 조문에 없는 것은 짐작하거나 지어내지 않습니다.\n- 근거가 없으면 '" + REFUSAL + "'라고 답합니다.\n- 끝에 근거로 쓴 법률 이름과 조문 번호를 적습니다.\n- 짧고 분명하게 쓰되 조문의 요점을 빠뜨리지 않습니다.\n\n[조문]\n{context}\n\n[질문]\n{question}\n\n[답변]\n"
#: The older forms: without the refusal; and with the articles alone.
PROMPT_OLD = "[규칙]\n- 아래 조문에 바로 나오는 사실만 씁니다.\n- 조문에 없는 것은 지어내지 않습니다.\n- 끝에 법률 이름과 조문 번호를 적습니다.\n\n[조문]\n{context}\n\n[질문]\n{question}\n\n[답변]\n"
PROMPT_BARE = "[조문]\n{context}\n\n[질문]\n{question}\n\n[답변]\n"


def attach_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with ``passage``: ``[article title] text``; a missing chunk gives an empty passage."""
    known = chunks.select("chunk_id", "article", "article_title", "text")
    head = F.when(F.col("article").isNotNull(), F.concat(F.lit("["), F.concat_ws(" ", "article", F.when(F.col("article_title") != "", F.col("article_title"))), F.lit("] "))).otherwise(F.lit(""))
    return hits.join(known, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("passage", F.concat(head, F.col("text")))


def overlap_scorer(query: Column, passage: Column) -> Column:
    """The deterministic stand-in for a cross-encoder: the share of the query's tokens in the passage."""
    q = tokenize(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenize(passage))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, top_k: int = 5, scorer=overlap_scorer, previous: str = "rank") -> DataFrame:
    """Hits (qid, query, passage, previous rank) by a scorer, best first, stable in the previous rank."""
    best = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), previous)
    scored = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("passage")))
    return scored.withColumn("rerank_rank", F.row_number().over(best)).where(F.col("rerank_rank") <= top_k).withColumnRenamed(previous, "previous_rank")


def build_context(hits: DataFrame, questions: DataFrame, rank: str = "rank", with_title: bool = True, default_law: str | None = None, top_k: int | None = None) -> DataFrame:
    """(qid, context, sources, n_docs): hits in order of rank as numbered passages.

    ``with_title`` false, ``default_law`` and ``top_k`` give the older form.
    """
    if top_k is not None:
        hits = hits.where(F.col(rank) <= top_k)
    law = F.col("law") if default_law is None else F.coalesce("law", F.lit(default_law))
    title = F.when(F.col("article_title") != "", F.concat(F.lit("("), F.col("article_title"), F.lit(")"))) if with_title else F.lit(None)
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("]")), law, F.concat(F.coalesce("article", F.lit("")), F.coalesce(title, F.lit(""))))
    entry = F.struct(F.col(rank).alias("rank"), F.concat(head, F.lit("\n"), F.col("text")).alias("entry"), F.when((law != "") & (F.col("article") != ""), F.concat_ws(" ", law, "article")).alias("source"))
    docs = hits.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("docs"))
    out = questions.select("qid").join(docs, "qid", "left")
    text = F.array_join(F.transform("docs", lambda d: d["entry"]), "\n\n")
    none = F.array().cast("array<string>")
    return out.select("qid", F.coalesce(text, F.lit(NO_CONTEXT)).alias("context"), F.coalesce(F.filter(F.transform("docs", lambda d: d["source"]), lambda s: s.isNotNull()), none).alias("sources"), F.coalesce(F.size("docs"), F.lit(0)).alias("n_docs"))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), question)


def answer_of(prompt: str) -> str:
    """The deterministic stand-in for a language model: the first passage's first 200 characters and its head, or the refusal."""
    head, _, body = prompt.split("[조문]\n", 1)[1].split("\n\n[질문]", 1)[0].partition("\n")
    said = body[:200].strip()
    return f"{said} ({head})" if said else REFUSAL


@F.pandas_udf(StringType())
def extractive_answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``answer_of`` each prompt."""
    for part in prompts:
        yield part.map(answer_of)


def retrieve(questions: DataFrame, points: DataFrame, chunks: DataFrame, use_reranker: bool = False, top_k: int = 5, candidates: int = 20, scorer=overlap_scorer) -> DataFrame:
    """Passages of each question (qid, law, query, embedding), rank from 1: dense within the question's law where it has one.

    With ``use_reranker`` the best ``top_k`` of ``candidates`` after re-scoring. ``dense_rank``
    stays; ``rerank_score`` is null without a reranker.
    """
    hits = dense_top_k(questions, points, candidates if use_reranker else top_k)
    hits = attach_texts(hits, chunks).join(questions.select("qid", "query"), "qid")
    if use_reranker:
        return rerank(hits, top_k, scorer, "dense_rank").withColumnsRenamed({"rerank_rank": "rank", "previous_rank": "dense_rank"})
    return hits.withColumns({"rank": F.col("dense_rank"), "rerank_score": F.lit(None).cast("double")})


def answer_questions(hits: DataFrame, questions: DataFrame, mode: str, model=extractive_answer, chars: int = 200) -> DataFrame:
    """hits of ``retrieve`` -> (qid, query, law, mode, docs, context, sources, n_docs, answer).

    docs: array<struct<rank, chunk_id, law, article, score, rerank_score, dense_rank, text>> in order of rank.
    """
    doc = F.struct("rank", "chunk_id", "law", "article", "score", "rerank_score", "dense_rank", F.left("text", F.lit(chars)).alias("text"))
    docs = hits.groupBy("qid").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    context = build_context(hits, questions).join(questions.select("qid", "query", "law"), "qid").join(docs, "qid", "left")
    answer = model(prompt(F.col("context"), F.col("query")))
    return context.select("qid", "query", "law", F.lit(mode).alias("mode"), F.coalesce("docs", F.array().cast(docs.schema["docs"].dataType)).alias("docs"), "context", "sources", "n_docs", answer.alias("answer"))


def run_rag(questions: DataFrame, points: DataFrame, chunks: DataFrame, use_reranker: bool = False, top_k: int = 5, candidates: int = 20, scorer=overlap_scorer, model=extractive_answer) -> DataFrame:
    """Retrieval and answers of a table of questions: see ``retrieve`` and ``answer_questions``."""
    hits = retrieve(questions, points, chunks, use_reranker, top_k, candidates, scorer)
    return answer_questions(hits, questions, "reranker" if use_reranker else "dense", lambda p: T.strip(model(p)))


def timed_rag(questions: DataFrame, points: DataFrame, chunks: DataFrame, use_reranker: bool = False, top_k: int = 5, candidates: int = 20, scorer=None, answer=answer_of) -> DataFrame:
    """``run_rag`` with retrieval_sec and llm_sec of each question.

    The times of scoring a question's pairs and of its answer are taken where they are
    computed. The search serves all questions at once: each has an equal share of its time.
    ``scorer``: (query, passage) -> struct<score, seconds>, such as ``models.timed_scorer``;
    ``answer``: prompt -> text.
    """
    n, began = max(1, questions.count()), time.perf_counter()
    hits = staged(retrieve(questions, points, chunks, False, candidates if use_reranker else top_k), "rag-hits")
    share = (time.perf_counter() - began) / n
    if use_reranker:
        scored = scorer or (lambda q, p: F.struct(overlap_scorer(q, p).alias("score"), F.lit(0.0).alias("seconds")))
        pairs = staged(hits.withColumn("s", scored(F.col("query"), F.col("passage"))), "rag-pairs")
        again = rerank(pairs.drop("rank", "rerank_score"), top_k, lambda q, p: F.col("s.score"), "dense_rank")
        spent = pairs.groupBy("qid").agg(F.sum("s.seconds").alias("scoring"))
        hits = again.withColumnsRenamed({"rerank_rank": "rank", "previous_rank": "dense_rank"}).join(spent, "qid")
    else:
        spent = questions.select("qid", F.lit(0.0).alias("scoring"))
    timed = timed_text(answer)
    out = answer_questions(hits, questions, "reranker" if use_reranker else "dense", timed)
    out = staged(out.withColumns({"llm_sec": F.col("answer.seconds"), "answer": T.strip(F.col("answer.text"))}), "rag-answers")
    return out.join(spent, "qid", "left").withColumn("retrieval_sec", F.lit(share) + F.coalesce("scoring", F.lit(0.0))).drop("scoring")
