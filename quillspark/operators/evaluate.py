"""Retrieval and answer metrics over tables of hits and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = r"제\d+조"


def first_rank(queries: DataFrame, hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Queries (qid, expected_chunk_id, ..) with correct_rank, reciprocal_rank and top1/3/5 flags."""
    right = hits.select("qid", F.col("chunk_id").alias("expected_chunk_id"), F.col(rank).alias("_rank"))
    found = queries.select("qid", "expected_chunk_id").join(right, ["qid", "expected_chunk_id"]).groupBy("qid").agg(F.min("_rank").alias("correct_rank"))
    out = queries.join(found, "qid", "left").withColumn("reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("correct_rank"), F.lit(0.0)))
    return out.withColumns({f"top{k}": F.coalesce(F.col("correct_rank") <= k, F.lit(False)) for k in (1, 3, 5)})


def search_summary(ranked: DataFrame, *keys: str) -> DataFrame:
    """total_questions, topK_correct, topK_accuracy and mrr, by ``keys``."""
    sums = [F.count("*").alias("total_questions")]
    for k in (1, 3, 5):
        sums += [F.count_if(f"top{k}").alias(f"top{k}_correct"), F.avg(F.col(f"top{k}").cast("double")).alias(f"top{k}_accuracy")]
    return ranked.groupBy(*keys).agg(*sums, F.avg("reciprocal_rank").alias("mrr"))


def candidate_recall(queries: DataFrame, hits: DataFrame, k: int = 20, rank: str = "rank") -> DataFrame:
    """One row: topK_recall (queries whose expected chunk is among K candidates) and its rate."""
    near = hits.where(F.col(rank) <= k).select("qid", F.col("chunk_id").alias("expected_chunk_id"))
    met = queries.select("qid", "expected_chunk_id").join(near.distinct().withColumn("_hit", F.lit(1)), ["qid", "expected_chunk_id"], "left")
    return met.agg(F.count("*").alias("total_questions"), F.count("_hit").alias(f"top{k}_recall"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias(f"top{k}_recall_rate"))


def evaluate_modes(queries: DataFrame, modes: dict[str, DataFrame]) -> DataFrame:
    """search_summary of each mode's hits (qid, rank, chunk_id), in one pass: a row per mode."""
    every = None
    for mode, hits in modes.items():
        own = first_rank(queries, hits).withColumn("mode", F.lit(mode))
        every = own if every is None else every.unionByName(own)
    return search_summary(every, "mode")


def compare_modes(summary: DataFrame, modes: list[str], metrics: tuple[str, ...] = ("top1_accuracy", "top3_accuracy", "top5_accuracy", "mrr")) -> DataFrame:
    """A row per metric, a column per mode."""
    long = summary.select("mode", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("e")).select("mode", "e.metric", "e.value")
    return long.groupBy("metric").pivot("mode", modes).agg(F.first("value"))


def mode_differences(summary: DataFrame, a: str, b: str, metrics: tuple[str, ...]) -> DataFrame:
    """metric, a's value, b's value and b - a."""
    wide = compare_modes(summary, [a, b], metrics)
    return wide.select("metric", F.col(a), F.col(b), (F.col(b) - F.col(a)).alias("difference"))


def has_source(answer: Column, sources: Column, strict: bool = False) -> Column:
    """Whether the answer names a source: all words of one, or any article number; ``strict`` wants the former."""
    named = F.exists(sources, lambda s: F.forall(F.split(s, r"\s+"), lambda w: F.contains(answer, w)))
    return named if strict else named | answer.rlike(CITATION)


def citations(text: Column, strict: bool = False) -> Column:
    """Distinct article numbers; ``strict`` keeps an article's branch number."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION + (r"(?:의\d+)?" if strict else "")), F.lit(0))))


def unsupported_citations(answer: Column, sources: Column, strict: bool = False) -> Column:
    """struct<flag, answer_articles, source_articles, unsupported>: cited but not in any source."""
    cited, given = citations(answer, strict), citations(F.array_join(sources, " "), strict)
    loose = F.array_sort(F.array_except(cited, given))
    return F.struct((F.size(loose) > 0).alias("flag"), cited.alias("answer_articles"), given.alias("source_articles"), loose.alias("unsupported"))


def rag_records(results: DataFrame, queries: DataFrame) -> DataFrame:
    """run_rag's rows, graded on their own docs: retrieval_rank and retrieval_hit of the expected chunk, answer_has_source, hallucination."""
    out = results.join(queries.select("qid", "expected_chunk_id"), "qid")
    own = F.filter("docs", lambda d: d["chunk_id"] == F.col("expected_chunk_id"))
    out = out.withColumn("retrieval_rank", F.array_min(F.transform(own, lambda d: d["rank"]))).withColumn("retrieval_hit", F.col("retrieval_rank").isNotNull())
    return out.withColumn("answer_has_source", has_source(F.col("answer"), F.col("sources"))).withColumn("hallucination", unsupported_citations(F.col("answer"), F.col("sources")))


def texts_that_hold(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, qid, ...): texts (doc_id, text, ...) that hold a whole phrase (qid, phrase) somewhere.

    A phrase's parts between spaces, its first and last aside, are parts of the text too: the
    longest is the key of a hash join, and what it proposes is verified. Phrases of one or two
    parts have no such key and are looked for in every text; null and empty phrases are held
    by none.
    """
    known = phrases.where(F.col("phrase") != "")
    parts = F.split("phrase", " ", -1)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    known = known.withColumn("key_", F.when(F.size(parts) >= 3, longest))
    places = texts.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("key_"))
    met = places.join(known.where("key_ IS NOT NULL").select("qid", "key_"), "key_").select("doc_id", "qid")
    short = known.where("key_ IS NULL").select("qid")
    if short.limit(1).count():
        met = met.unionByName(texts.select("doc_id").crossJoin(F.broadcast(short.limit(SHORT_PHRASES))))
        if short.limit(SHORT_PHRASES + 1).count() > SHORT_PHRASES:
            raise ValueError(f"more than {SHORT_PHRASES} phrases of one or two words")
    whole = met.join(texts, "doc_id").join(known.drop("key_"), "qid")
    return whole.where(F.contains("text", "phrase"))


#: Phrases of one or two words that are looked for in every text.
SHORT_PHRASES = 1000


def rag_summary(records: DataFrame, *keys: str) -> DataFrame:
    """Counts and percentages (one decimal) of hits, of hits at 1, 3 and 5, of answers with a source and of flagged answers.

    Mean seconds (two decimals) where the records have them.
    """
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100, 1)
    rank, flag = F.col("retrieval_rank"), F.col("hallucination.flag")
    hit, source = F.col("retrieval_hit"), F.col("answer_has_source")
    sums = [F.count("*").alias("total_questions"), F.count_if(hit).alias("retrieval_hit"), rate(hit).alias("retrieval_hit_rate")]
    sums += [rate(rank <= k).alias(f"top{k}_rate") for k in (1, 3, 5)]
    sums += [F.count_if(source).alias("answer_has_source"), rate(source).alias("source_rate"), F.count_if(flag).alias("hallucination_count"), rate(flag).alias("hallucination_rate")]
    sums += [F.round(F.avg(c), 2).alias(f"avg_{c}") for c in ("retrieval_sec", "llm_sec") if c in records.columns]
    return records.groupBy(*keys).agg(*sums)


def flagged(records: DataFrame) -> DataFrame:
    """Records whose answer cites what no source has."""
    return records.where("hallucination.flag")


def failures(ranked: DataFrame) -> DataFrame:
    return ranked.where(~F.col("top5"))


def failure_texts(ranked: DataFrame, hits: DataFrame, chunks: DataFrame, chars: int = 1000) -> DataFrame:
    """Failed queries with what was retrieved: (qid, query, rank, chunk_id, preview)."""
    from ..functions.text import preview

    missed = failures(ranked).select("qid", "query", "expected_chunk_id")
    return missed.join(hits.select("qid", "rank", "chunk_id"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id", "left").select("qid", "query", "expected_chunk_id", "rank", "chunk_id", preview(F.coalesce("text", F.lit("")), chars).alias("preview"))


def chunk_statistics(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count_if(F.col("section") == "본문").alias("main"), F.count_if(F.col("section") == "부칙").alias("supplement"), *(F.count_if(F.col("chunk_type") == t).alias(t) for t in ("article", "paragraph", "item")), F.count_distinct("section", F.coalesce("article", F.lit(""))).alias("articles"))


def counts_by_kind(evalset: DataFrame) -> DataFrame:
    """Counts by law, by query type and by difficulty, in one pass."""
    sets = evalset.groupingSets([["law"], ["query_type"], ["difficulty"]], "law", "query_type", "difficulty").agg(F.count("*").alias("n"))
    kind = F.when(F.col("law").isNotNull(), "law").when(F.col("query_type").isNotNull(), "query_type").otherwise("difficulty")
    return sets.select(kind.alias("kind"), F.coalesce("law", "query_type", "difficulty").alias("value"), "n")
