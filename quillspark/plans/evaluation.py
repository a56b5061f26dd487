"""Metrics, audits and evaluation sets."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import dense, evalset, fusion, lexical, models
from ..operators import evaluate as M
from ..operators import validate as V
from ..sources import files
from ..storage import shared_folder, staged
from .registry import query, table
from .retrieval import DENSE, RAG_STEPS, bm25_sql, doc_chunks, hybrid_inputs, listed, pair_scorer, points, text_queries, vector_queries
from .statutes import strip_sql
from .texts import TOKENS


def self_retrieval(spark, sf_dir):
    """(queries, dense hits); expected: the nearest other vector of the label."""
    q, p = vector_queries(spark, sf_dir), points(spark, sf_dir)
    every = staged(dense.dense_top_k(q, p, 20, by_law=False, exclude_self=True).withColumnRenamed("dense_rank", "rank"), "dense")
    own = dense.dense_top_k(q, p, 1, by_law=True, exclude_self=True)
    expected = own.select("qid", F.col("chunk_id").alias("expected_chunk_id"))
    return q.select("qid", "law").join(expected, "qid"), every.where("rank <= 5")


SELF = f"""WITH {DENSE.format("AND q.vec_id <> p.vec_id", 20)},
own_all AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dense_all WHERE law = q_law),
expected AS (SELECT qid, chunk_id AS expected, law FROM own_all WHERE rank = 1),
ranked AS (SELECT 'dense' AS mode, e.qid, e.law, e.expected, min(dense_rank) AS r FROM expected e LEFT JOIN dense d ON d.qid = e.qid AND d.chunk_id = e.expected AND dense_rank <= 5 GROUP BY ALL)"""


@query("M01_M02_M04_first_rank", SELF + " SELECT qid, expected AS expected_chunk_id, r::INT AS correct_rank, round(coalesce(1.0 / r, 0), 9)::DOUBLE AS reciprocal_rank, coalesce(r <= 1, false) AS top1, coalesce(r <= 3, false) AS top3, coalesce(r <= 5, false) AS top5 FROM ranked WHERE mode = 'dense'")
def first_rank(spark, sf_dir):
    q, every = self_retrieval(spark, sf_dir)
    return M.first_rank(q, every).drop("law").withColumn("reciprocal_rank", F.round("reciprocal_rank", 9))


def graded_questions(spark, sf_dir):
    """(questions, points, chunks): benchmark items that a document holds, each with the vector of its number.

    Expected are the first such document and its law, whatever any way of searching says.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where("text <> ''")
    held = M.texts_that_hold(docs.select("doc_id", "source", "text"), items.select(F.col("item_id").alias("qid"), F.col("text").alias("phrase"))).withColumnRenamed("phrase", "query")
    first = held.groupBy("qid", "query").agg(F.min(F.struct("doc_id", "source")).alias("d")).select("qid", "query", F.col("d.source").alias("law"), F.col("d.doc_id").alias("expected_chunk_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return staged(first.join(vectors, "qid"), "questions"), hybrid_inputs(spark, sf_dir)[1], doc_chunks(spark, sf_dir)


GRADED = """expq AS (SELECT item_id AS qid, min(doc_id) AS expected FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text) GROUP BY 1),
q AS (SELECT qid, d.source AS law, b.text, expected FROM expq JOIN benchmark b ON item_id = qid JOIN documents d ON d.doc_id = expected WHERE qid IN (SELECT vec_id FROM embeddings)),"""
GRADED_VECTORS = "vq AS (SELECT qid, law AS q_law, text AS query, expected, embedding FROM q JOIN embeddings ON qid = vec_id)"
MODES = f"""WITH {GRADED}
{bm25_sql(True, 50, True).strip().replace("q AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS law, text FROM benchmark),", "")},
{GRADED_VECTORS},
vp AS (SELECT vec_id AS chunk_id, source AS law, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
dall AS (SELECT qid, chunk_id, vp.law, q_law, list_cosine_similarity(vq.embedding::DOUBLE[], vp.embedding::DOUBLE[]) AS score FROM vq, vp),
free AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dall),
dns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS dense_rank FROM dall WHERE law = q_law) WHERE dense_rank <= 50),
fused AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, coalesce(1.0 / (5 + dense_rank), 0) + coalesce(1.0 / (5 + rank), 0) AS rrf, dense_rank, rank AS bm25_rank FROM dns d FULL OUTER JOIN lex l ON d.qid = l.qid AND d.chunk_id = l.chunk_id),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM fused) WHERE rank <= 20),
pairs AS (SELECT hyb.qid, hyb.rank, chunk_id, {TOKENS.format("coalesce(q.text, chr(32))")} AS qs, {TOKENS.format("'제' || (doc_id % 97 + 1) || '조 ' || left(string_split(coalesce(d.text, ''), chr(10))[1], 20) || ' ' || coalesce(d.text, '')")} AS ps FROM hyb JOIN q USING (qid) JOIN documents d ON d.doc_id = chunk_id),
rer AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(qs, ps)) / len(qs) DESC, rank) AS rank FROM pairs),
hits AS (SELECT 'dense' AS mode, qid, chunk_id, rank FROM free UNION ALL SELECT 'filter', qid, chunk_id, dense_rank FROM dns UNION ALL SELECT 'hybrid', qid, chunk_id, rank FROM hyb UNION ALL SELECT 'reranker', qid, chunk_id, rank FROM rer),
ranked AS (SELECT m.mode, q.qid, expected, min(h.rank) AS r FROM q CROSS JOIN (VALUES ('dense'), ('filter'), ('hybrid'), ('reranker')) m(mode) LEFT JOIN hits h ON h.mode = m.mode AND h.qid = q.qid AND h.chunk_id = expected AND h.rank <= 5 GROUP BY ALL),
recall AS (SELECT count(*) AS top20_recall, count(*) / (SELECT count(*) FROM q) AS top20_recall_rate FROM q JOIN hyb ON hyb.qid = q.qid AND hyb.chunk_id = expected),
summary AS (SELECT mode, count(*) AS total_questions, count(*) FILTER (r <= 1) AS top1_correct, count(*) FILTER (r <= 3) AS top3_correct, count(*) FILTER (r <= 5) AS top5_correct, round(avg((coalesce(r, 99) <= 1)::INT), 4) AS top1_accuracy, round(avg((coalesce(r, 99) <= 3)::INT), 4) AS top3_accuracy, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS top5_accuracy, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM ranked GROUP BY mode)"""


def mode_hits(spark, sf_dir):
    """(questions, hits of each of the four modes, hybrid candidates): what is compared."""
    q, p, chunks = graded_questions(spark, sf_dir)
    wide = staged(fusion.hybrid_search(q, p, chunks, 20, by_law=True), "hybrid")
    again = A.rerank(A.attach_texts(wide.select("qid", "rank", "chunk_id", "law"), chunks).join(q.select("qid", "query"), "qid"))
    modes = {
        "dense": dense.dense_top_k(q, p, 5, by_law=False).withColumnRenamed("dense_rank", "rank"),
        "filter": dense.dense_top_k(q, p, 5, by_law=True).withColumnRenamed("dense_rank", "rank"),
        "hybrid": wide.where("rank <= 5"),
        "reranker": again.select("qid", F.col("rerank_rank").alias("rank"), "chunk_id"),
    }
    return q.select("qid", "expected_chunk_id"), modes, wide


ACCURACIES = ("top1_accuracy", "top3_accuracy", "top5_accuracy", "mrr")


def _summary(spark, sf_dir):
    """A row a mode, rates to four decimals; the recall of the hybrid candidates is the reranker's."""
    q, modes, wide = mode_hits(spark, sf_dir)
    recall = M.candidate_recall(q, wide, 20).select(F.lit("reranker").alias("mode"), "top20_recall", F.round("top20_recall_rate", 4).alias("top20_recall_rate"))
    summary = M.evaluate_modes(q, modes).withColumns({c: F.round(c, 4) for c in ACCURACIES})
    return summary.join(recall, "mode", "left")


@query("M03_M06_evaluate_modes", MODES + " SELECT mode, total_questions, top1_correct, top1_accuracy, top3_correct, top3_accuracy, top5_correct, top5_accuracy, mrr, CASE WHEN mode = 'reranker' THEN top20_recall END AS top20_recall, CASE WHEN mode = 'reranker' THEN round(top20_recall_rate, 4) END AS top20_recall_rate FROM summary, recall")
def evaluate_modes(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("M05_candidate_recall", MODES + " SELECT (SELECT count(*) FROM q) AS total_questions, top20_recall, round(top20_recall_rate, 9) AS top20_recall_rate FROM recall")
def candidate_recall(spark, sf_dir):
    q, _, wide = mode_hits(spark, sf_dir)
    return M.candidate_recall(q, wide, 20).withColumn("top20_recall_rate", F.round("top20_recall_rate", 9))


@query("M07_compare_modes", MODES + """ SELECT metric, max(v) FILTER (mode = 'dense') AS dense, max(v) FILTER (mode = 'filter') AS filter, max(v) FILTER (mode = 'hybrid') AS hybrid, max(v) FILTER (mode = 'reranker') AS reranker
FROM (UNPIVOT (SELECT mode, top1_accuracy, top3_accuracy, top5_accuracy, mrr FROM summary) ON top1_accuracy, top3_accuracy, top5_accuracy, mrr INTO NAME metric VALUE v) GROUP BY metric""")
def compare_modes(spark, sf_dir):
    return M.compare_modes(_summary(spark, sf_dir), ["dense", "filter", "hybrid", "reranker"], ACCURACIES)


def cited(spark, sf_dir):
    """Each text as an answer that cites some articles, and two sources."""
    docs = table(spark, sf_dir, "documents")
    no = F.col("doc_id")
    mark = lambda k: F.concat(F.lit("제"), k.cast("string"), F.lit("조"))
    answer = F.when(no % 4 == 0, F.coalesce("text", F.lit(""))).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), mark(no % 7), F.lit(", "), mark(no % 5)))
    return docs.select("doc_id", answer.alias("answer"), F.array(F.concat(F.col("source"), F.lit(" "), mark(no % 7)), F.concat(F.col("source"), F.lit(" "), mark(no % 3))).alias("sources"))


CITED = """cited AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || ' 제' || (doc_id % 7) || '조, 제' || (doc_id % 5) || '조' END AS answer, source, '제' || (doc_id % 7) || '조' AS a, '제' || (doc_id % 3) || '조' AS b FROM documents),
cites AS (SELECT *, list_sort(list_distinct(regexp_extract_all(answer, '제\\d+조'))) AS given, list_sort(list_distinct([a, b])) AS known FROM cited)"""


@query("M08_has_source", f"WITH {CITED} SELECT doc_id, (contains(answer, source) AND (contains(answer, a) OR contains(answer, b))) OR regexp_matches(answer, '제\\d+조') AS has_source, contains(answer, source) AND (contains(answer, a) OR contains(answer, b)) AS strict FROM cited")
def has_source(spark, sf_dir):
    return cited(spark, sf_dir).select("doc_id", M.has_source(F.col("answer"), F.col("sources")).alias("has_source"), M.has_source(F.col("answer"), F.col("sources"), strict=True).alias("strict"))


@query("M09_X02_unsupported", f"WITH {CITED} SELECT doc_id, array_to_string(given, ',') AS answer_articles, array_to_string(known, ',') AS source_articles, array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains(known, x))), ',') AS unsupported, len(list_filter(given, lambda x: NOT list_contains(known, x))) > 0 AS flag FROM cites")
def unsupported(spark, sf_dir):
    rows = cited(spark, sf_dir).select("doc_id", M.unsupported_citations(F.col("answer"), F.col("sources")).alias("h"))
    return rows.select("doc_id", *(F.array_join(f"h.{c}", ",").alias(c) for c in ("answer_articles", "source_articles", "unsupported")), "h.flag")


def _records(spark, sf_dir, timed=False):
    """Graded answers in both modes, each on its own documents; the search is within the expected law."""
    q, p, chunks = graded_questions(spark, sf_dir)
    if timed:
        scorer = models.timed_scorer(*pair_scorer(spark))
        return M.rag_records(A.timed_rag(q, p, chunks).unionByName(A.timed_rag(q, p, chunks, use_reranker=True, scorer=scorer)), q)
    return M.rag_records(A.run_rag(q, p, chunks).unionByName(A.run_rag(q, p, chunks, use_reranker=True)), q)


RECORDS = f"""{GRADED}
{GRADED_VECTORS},
{RAG_STEPS},
graded AS (SELECT rag.*, q.expected, nullif(list_position(doc_ids, q.expected), 0) AS retrieval_rank FROM rag JOIN q USING (qid)),
records AS (SELECT qid, query, expected AS expected_chunk_id, mode, docs, retrieval_rank IS NOT NULL AS retrieval_hit, retrieval_rank::INT AS retrieval_rank, answer, sources,
  len(list_filter(string_split(sources, '|'), lambda s: s <> '' AND contains(answer, string_split(s, ' ')[1]) AND contains(answer, string_split(s, ' ')[2]))) > 0 OR regexp_matches(answer, '제\\d+조') AS answer_has_source,
  len(list_filter(regexp_extract_all(answer, '제\\d+조'), lambda c: NOT list_contains(regexp_extract_all(sources, '제\\d+조'), c))) > 0 AS flag FROM graded),
rsum AS (SELECT mode, count(*) AS total_questions, count(*) FILTER (retrieval_hit) AS retrieval_hit, round(avg(retrieval_hit::INT) * 100, 1) AS retrieval_hit_rate, round(avg(coalesce(retrieval_rank <= 1, false)::INT) * 100, 1) AS top1_rate, round(avg(coalesce(retrieval_rank <= 3, false)::INT) * 100, 1) AS top3_rate, round(avg(coalesce(retrieval_rank <= 5, false)::INT) * 100, 1) AS top5_rate,
  count(*) FILTER (answer_has_source) AS answer_has_source, round(avg(answer_has_source::INT) * 100, 1) AS source_rate, count(*) FILTER (flag) AS hallucination_count, round(avg(flag::INT) * 100, 1) AS hallucination_rate FROM records GROUP BY mode)"""


@query("M10_rag_records", f"WITH {RECORDS} SELECT qid, query, expected_chunk_id, mode, docs AS retrieved_chunks, retrieval_hit, retrieval_rank, answer_has_source, flag, answer FROM records")
def rag_records(spark, sf_dir):
    out = _records(spark, sf_dir)
    return out.select("qid", "query", "expected_chunk_id", "mode", listed(F.col("docs")).alias("retrieved_chunks"), "retrieval_hit", "retrieval_rank", "answer_has_source", F.col("hallucination.flag").alias("flag"), "answer")


@query("M11_rag_summary", f"WITH {RECORDS} SELECT * FROM rsum")
def rag_summary(spark, sf_dir):
    return M.rag_summary(_records(spark, sf_dir), "mode")


DIFFERENCES = ("retrieval_hit_rate", "top1_rate", "top3_rate", "hallucination_rate")


@query("M12_rag_differences", f"WITH {RECORDS} SELECT metric, dense, reranker, round(reranker - dense, 1) AS difference FROM (SELECT metric, max(v) FILTER (mode = 'dense') AS dense, max(v) FILTER (mode = 'reranker') AS reranker FROM (UNPIVOT (SELECT mode, {', '.join(DIFFERENCES)} FROM rsum) ON {', '.join(DIFFERENCES)} INTO NAME metric VALUE v) GROUP BY metric)")
def rag_differences(spark, sf_dir):
    wide = M.mode_differences(M.rag_summary(_records(spark, sf_dir), "mode"), "dense", "reranker", DIFFERENCES)
    return wide.withColumn("difference", F.round("difference", 1))


@query("M15_rag_times")
def rag_times(spark, sf_dir):
    """Mean seconds a question in both modes, and the difference; measured, so SQL can't give them."""
    summary = M.rag_summary(_records(spark, sf_dir, timed=True), "mode")
    wide = M.mode_differences(summary, "dense", "reranker", ("avg_retrieval_sec", "avg_llm_sec"))
    return wide.withColumn("difference", F.round("difference", 2))


@query("M15_times_by_question", f"WITH {GRADED} m AS (SELECT unnest(['dense', 'reranker']) AS mode) SELECT qid, mode, true AS searched, true AS answered FROM q, m")
def times_by_question(spark, sf_dir):
    """Each question's own times, as far as they don't change from run to run: that they are there."""
    return _records(spark, sf_dir, timed=True).select("qid", "mode", (F.col("retrieval_sec") > 0).alias("searched"), (F.col("llm_sec") > 0).alias("answered"))


@query("F06_flagged_answers", f"WITH {CITED}, asked AS (SELECT doc_id, len(list_filter(given, lambda x: NOT list_contains(known, x))) > 0 AS flag FROM cites) SELECT doc_id FROM asked WHERE flag")
def flagged_answers(spark, sf_dir):
    rows = cited(spark, sf_dir).select("doc_id", M.unsupported_citations(F.col("answer"), F.col("sources")).alias("hallucination"))
    return M.flagged(rows).select("doc_id")


def ranked_texts(spark, sf_dir):
    """Benchmark questions ranked by BM25; the expected document is the one of the question's number."""
    q = text_queries(spark, sf_dir).withColumn("expected_chunk_id", F.col("qid"))
    hits = lexical.bm25_top_k(q, doc_chunks(spark, sf_dir), 5)
    return M.first_rank(q, hits), hits


@query("F05_F06_failures", f"WITH {bm25_sql(False, 5, True).strip()} SELECT q.qid FROM q WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.qid = q.qid AND lex.chunk_id = q.qid)")
def failures(spark, sf_dir):
    return M.failures(ranked_texts(spark, sf_dir)[0]).select("qid")


@query("J06_Q09_failure_texts", f"WITH {bm25_sql(False, 5, True).strip()} SELECT lex.qid, q.text AS query, lex.qid AS expected_chunk_id, rank::INT AS rank, chunk_id, CASE WHEN length(d.text) > 60 THEN left(d.text, 60) || '...' ELSE coalesce(d.text, '') END AS preview FROM lex JOIN q USING (qid) JOIN documents d ON d.doc_id = chunk_id WHERE NOT EXISTS (SELECT 1 FROM lex o WHERE o.qid = lex.qid AND o.chunk_id = lex.qid)")
def failure_texts(spark, sf_dir):
    ranked, hits = ranked_texts(spark, sf_dir)
    return M.failure_texts(ranked, hits, doc_chunks(spark, sf_dir), 60)


# evaluation sets


def law_chunks(spark, sf_dir):
    """Documents as statute chunks of 20 laws: the title is in the text, after the article's number."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    no = F.col("doc_id")
    article = F.concat(F.lit("제"), (F.floor(no / 20) % 40 + 1).cast("string"), F.lit("조"))
    title = F.when(no % 3 != 0, F.regexp_extract("text", r"(\p{L}+)", 1)).otherwise(F.lit(""))
    text = F.concat(article, F.when(title != "", F.concat(F.lit("("), title, F.lit(") "))).otherwise(F.lit(" ")), F.col("text"))
    return docs.select(F.col("source").alias("law"), article.alias("article"), no.cast("string").alias("chunk_id"), text.alias("text"), no.alias("pos"))


LAW = rf"""base AS (SELECT source AS law, '제' || ((doc_id // 20) % 40 + 1) || '조' AS article, ((doc_id // 20) % 40 + 1)::INT AS number, doc_id::VARCHAR AS chunk_id, doc_id AS pos, CASE WHEN doc_id % 3 <> 0 THEN regexp_extract(text, '(\p{{L}}+)', 1) ELSE '' END AS t, text AS body FROM documents WHERE text IS NOT NULL),
full_text AS (SELECT *, {strip_sql("article || CASE WHEN t <> '' THEN '(' || t || ') ' ELSE ' ' END || body")} AS text FROM base),
arts AS (SELECT law, article, chunk_id, text, {strip_sql(r"regexp_extract(text, '제\s*\d+\s*조(?:의\s*\d+)?\s*\(([^)]+)\)', 1)")} AS title, number, pos FROM full_text)"""
#: Words that occur in the driver's texts, in the place of the statutes' keywords.
WORDS = ("the", "and", "tion", "der", "que", "les")
_SCORE = "CASE WHEN number <= 5 THEN 30 WHEN number <= 10 THEN 15 WHEN number <= 20 THEN 5 ELSE 0 END + 15 * (" + " + ".join(f"contains(title, '{w}')::INT" for w in WORDS) + ") + least(2 * (" + " + ".join(f"contains(text, '{w}')::INT" for w in WORDS) + "), 20) - CASE WHEN length(text) < 30 THEN 10 ELSE 0 END - CASE WHEN length(text) > 2000 THEN 5 ELSE 0 END"
CHOSEN = LAW + f""",
scored AS (SELECT *, {_SCORE} AS importance FROM arts),
chosen AS (SELECT *, row_number() OVER (PARTITION BY law ORDER BY number, article, pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY importance DESC, number, pos) AS nth FROM scored) WHERE nth <= 10)"""


@query("Q01_extract_articles", f"WITH {LAW} SELECT law, article, chunk_id, text, title, number, pos FROM arts")
def extract_articles(spark, sf_dir):
    return evalset.extract_articles(law_chunks(spark, sf_dir))


@query("Q02_extract_articles_simple", f"WITH {LAW} SELECT law, article, chunk_id, pos FROM arts")
def extract_articles_simple(spark, sf_dir):
    return evalset.extract_articles_simple(law_chunks(spark, sf_dir)).drop("text")


@query("Q03_importance", f"WITH {CHOSEN} SELECT chunk_id, importance::INT AS importance FROM scored")
def importance(spark, sf_dir):
    arts = extract_articles(spark, sf_dir)
    return arts.select("chunk_id", evalset.importance(F.col("number"), F.col("title"), F.col("text"), WORDS).alias("importance"))


def _chosen(spark, sf_dir):
    return evalset.select_articles(extract_articles(spark, sf_dir), keywords=WORDS)


@query("Q04_W03_select_articles", f"WITH {CHOSEN} SELECT law, article, chunk_id, importance::INT AS importance, place::INT AS place FROM chosen")
def select_articles(spark, sf_dir):
    return _chosen(spark, sf_dir).select("law", "article", "chunk_id", "importance", "place")


FORMS = " UNION ALL ".join(
    f"SELECT law, article, chunk_id, place, {n} AS no, '{kind}' AS query_type, '{level}' AS difficulty, replace(replace(replace(CASE WHEN title <> '' THEN '{a}' ELSE '{b}' END, '{{L}}', law), '{{A}}', article), '{{T}}', title) AS query FROM chosen" for n, (kind, level, a, b) in enumerate(evalset.TEMPLATES)
)


@query("Q05_make_queries", f"WITH {CHOSEN}, forms AS ({FORMS}) SELECT law, article, chunk_id, place::INT AS place, no, query_type, difficulty, query FROM forms")
def make_queries(spark, sf_dir):
    return evalset.make_queries(_chosen(spark, sf_dir))


@query("W04_number_queries", f"WITH {CHOSEN}, forms AS ({FORMS}) SELECT row_number() OVER (ORDER BY law, place, no) AS id, law, chunk_id, query_type FROM forms")
def number_queries(spark, sf_dir):
    return evalset.number_queries(make_queries(spark, sf_dir)).select("id", "law", "chunk_id", "query_type")


@query("Q06_W02_query_template", f"WITH {LAW} SELECT law, article, chunk_id, place::INT AS place, '' AS query FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY pos) AS place FROM arts) WHERE place <= 5")
def query_template(spark, sf_dir):
    return evalset.query_template(law_chunks(spark, sf_dir))


def old_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("query"), F.lit("L").alias("expected_law"), F.concat(F.lit("제"), (F.col("turn") + 1).cast("string"), F.lit("조")).alias("expected_article"), F.col("conv_id").cast("string").alias("expected_chunk_id"))


def fixes(spark, sf_dir):
    old = old_queries(spark, sf_dir).where(F.col("id") % 3 == 0)
    return old.select("id", F.when(F.col("id") % 2 == 0, "fix_question").otherwise("fix_answer").alias("action"), F.upper("query").alias("new_query"), F.lit("M").alias("new_law"), F.when(F.col("id") % 9 == 0, "제1조").alias("new_article"), F.concat("expected_chunk_id", F.lit("b")).alias("new_chunk_id"), F.lit("").alias("reason"))


OLD = "old AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS query, 'L' AS expected_law, '제' || (turn + 1) || '조' AS expected_article, conv_id::VARCHAR AS expected_chunk_id FROM conversations WHERE role = 'user')"
NEW = OLD + ", new AS (SELECT id, CASE WHEN id % 6 = 0 THEN upper(query) ELSE query END AS query, CASE WHEN id % 3 = 0 THEN 'M' ELSE expected_law END AS expected_law, CASE WHEN id % 9 = 0 THEN '제1조' ELSE expected_article END AS expected_article, CASE WHEN id % 3 = 0 THEN expected_chunk_id || 'b' ELSE expected_chunk_id END AS expected_chunk_id, id % 3 = 0 AS corrected FROM old)"


@query("Q07_J07_corrections", f"WITH {NEW.replace('upper(query)', 'query')} SELECT * FROM new")
def corrections(spark, sf_dir):
    return evalset.apply_corrections(old_queries(spark, sf_dir), fixes(spark, sf_dir).withColumn("new_query", F.lit(None).cast("string")))


@query("J09_missing_targets", f"WITH {OLD} SELECT id FROM old WHERE id % 3 = 0 AND (id // 1000) % 2 = 1")
def missing_targets(spark, sf_dir):
    known = old_queries(spark, sf_dir).where(F.floor(F.col("id") / 1000) % 2 == 0).select(F.concat("expected_chunk_id", F.lit("b")).alias("chunk_id"))
    return evalset.missing_targets(fixes(spark, sf_dir), known).select("id")


@query("J10_changed_queries", f"WITH {NEW.replace('upper(query)', 'query')} SELECT id, field, o AS old_value, n AS new_value FROM (SELECT o.id, unnest(['expected_law', 'expected_article', 'expected_chunk_id']) AS field, unnest([o.expected_law, o.expected_article, o.expected_chunk_id]) AS o, unnest([n.expected_law, n.expected_article, n.expected_chunk_id]) AS n FROM old o JOIN new n USING (id)) WHERE o <> n")
def changed_queries(spark, sf_dir):
    return evalset.changed_queries(old_queries(spark, sf_dir), corrections(spark, sf_dir))


@query("Q08_J05_S12_audit", f"WITH {OLD} SELECT id, query, expected_chunk_id, CASE WHEN d.doc_id IS NOT NULL THEN '제' || (d.doc_id % 97 + 1) || '조' END AS found_article, CASE WHEN length(d.text) > 200 THEN left(d.text, 200) || '...' ELSE coalesce(d.text, '') END AS preview FROM old LEFT JOIN documents d ON d.doc_id::VARCHAR = expected_chunk_id")
def audit(spark, sf_dir):
    return evalset.audit(old_queries(spark, sf_dir), doc_chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")))


@query("M14_counts_by_kind", f"WITH {CHOSEN}, forms AS ({FORMS}) SELECT 'law' AS kind, law AS value, count(*) AS n FROM forms GROUP BY law UNION ALL SELECT 'query_type', query_type, count(*) FROM forms GROUP BY query_type UNION ALL SELECT 'difficulty', difficulty, count(*) FROM forms GROUP BY difficulty")
def counts_by_kind(spark, sf_dir):
    return M.counts_by_kind(make_queries(spark, sf_dir))


@query("V13_duplicate_queries", f"WITH {CHOSEN}, forms AS ({FORMS}) SELECT NULL::VARCHAR AS document, 'V13' AS \"check\", query AS offending_id FROM forms GROUP BY query HAVING count(*) > 1")
def duplicate_queries(spark, sf_dir):
    return V.duplicates(make_queries(spark, sf_dir), ["query"], "V13")


@query("V14_duplicate_targets", f"WITH {OLD} SELECT NULL::VARCHAR AS document, 'V14' AS \"check\", expected_chunk_id AS offending_id FROM old GROUP BY expected_chunk_id HAVING count(*) > 1")
def duplicate_targets(spark, sf_dir):
    return V.duplicates(old_queries(spark, sf_dir), ["expected_chunk_id"], "V14")


@query("S08_K08_query_files", f"WITH {OLD} SELECT * FROM old")
def query_files(spark, sf_dir):
    folder = shared_folder(spark, "queries")
    old_queries(spark, sf_dir).write.json(folder)
    return files.read_queries(spark, folder).select("id", "query", "expected_law", "expected_article", "expected_chunk_id")


@query("S09_K07_result_files", SELF + " SELECT qid, r::INT AS correct_rank, round(coalesce(1.0 / r, 0), 9)::DOUBLE AS reciprocal_rank FROM ranked WHERE mode = 'dense'")
def result_files(spark, sf_dir):
    q, every = self_retrieval(spark, sf_dir)
    ranked = staged(M.first_rank(q, every), "ranked")
    folder = shared_folder(spark, "results")
    files.write_results(ranked, M.search_summary(ranked), folder)
    back = files.read_results(spark, folder, "qid long, correct_rank int, reciprocal_rank double")
    return back.withColumn("reciprocal_rank", F.round("reciprocal_rank", 9))


def _chunk_files(spark, sf_dir, faulty: bool) -> str:
    """Documents as chunk files, a folder for each law; with ``faulty`` some ids and texts are missing or repeated."""
    no, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    own = no.cast("string")
    ident = F.when(no % 9 == 0, "").when(no % 8 == 0, F.concat(F.lit("x"), F.floor(no / 16).cast("string"))).otherwise(own) if faulty else own
    text = F.when(no % 7 == 0, " ").otherwise(F.col("text")) if faulty else F.col("text")
    folder = shared_folder(spark, "law-files")
    docs.select(ident.alias("id"), text.alias("text"), F.struct(F.col("source").alias("law_name")).alias("metadata"), F.col("source").alias("part")).write.partitionBy("part").json(folder)
    return folder


@query("S07_X01_chunks_by_law", "SELECT source AS law, count(*) AS chunks, min(doc_id::VARCHAR) AS first_id FROM documents WHERE source IS NOT NULL GROUP BY source")
def chunks_by_law(spark, sf_dir):
    folder = _chunk_files(spark, sf_dir, False)
    laws = [r.source for r in table(spark, sf_dir, "documents").select("source").where("source is not null").distinct().collect()]  # the sources: some tens
    every = files.read_law_chunks(spark, {law: f"{folder}/part={law}" for law in laws})
    return every.groupBy("law").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"))


_FAULTY_FILES = "f AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 8 = 0 THEN 'x' || (doc_id // 16) ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE coalesce(text, '') END AS text FROM documents)"


@query("S06_chunk_file_faults", f"WITH {_FAULTY_FILES} SELECT 'no id' AS fault, '' AS id, count(*) AS n FROM f WHERE id = '' HAVING count(*) > 0 UNION ALL SELECT 'no text', id, count(*) FROM f WHERE {strip_sql('text')} = '' GROUP BY id UNION ALL SELECT 'repeated id', id, count(*) FROM f WHERE id <> '' GROUP BY id HAVING count(*) > 1")
def chunk_file_faults(spark, sf_dir):
    return files.chunk_file_faults(files.read_chunks(spark, _chunk_files(spark, sf_dir, True)))


@query("S08_V13_query_file_faults", f"WITH {OLD} SELECT id::VARCHAR AS id, 'V13' AS fault FROM old WHERE id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id::VARCHAR = expected_chunk_id) UNION ALL SELECT id::VARCHAR, 'expected_chunk_id' FROM old WHERE id % 5 = 0 UNION ALL SELECT id::VARCHAR, 'query' FROM old WHERE id % 7 = 0 OR query = ''")
def query_file_faults(spark, sf_dir):
    """A query set with planted faults, written, read and checked: required fields, and expected chunks that exist."""
    folder = shared_folder(spark, "queries")
    rows = old_queries(spark, sf_dir).withColumns({"query": F.when(F.col("id") % 7 == 0, "").otherwise(F.col("query")), "expected_chunk_id": F.when(F.col("id") % 5 != 0, F.col("expected_chunk_id"))})
    rows.write.json(folder)
    back = files.read_queries(spark, folder)
    fields = V.missing_fields(back, ("query", "expected_law", "expected_article", "expected_chunk_id")).select(F.col("id").cast("string").alias("id"), F.col("field").alias("fault"))
    lost = V.missing_expected(back, doc_chunks(spark, sf_dir)).select(F.col("offending_id").alias("id"), F.col("check").alias("fault"))
    return fields.unionByName(lost)
