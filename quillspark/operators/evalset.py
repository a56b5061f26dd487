"""Evaluation sets: articles chosen by importance, question templates, corrections, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunk import first_of_each

#: Words that mark an important article.
KEYWORDS = ("목적", "정의", "적용 범위", "적용범위", "국가", "지방자치단체", "기본", "원칙", "사업주", "사용자", "근로자", "보호", "책임", "의무", "보험", "보험료", "급여", "재해", "안전", "보건", "교육", "훈련", "권리")
#: Fixed values: (type, difficulty, template with a title, template without).
TEMPLATES = (
    ("direct", "easy", "{L}에서 {A}({T})의 내용은 무엇인가요?", "{L}의 {A}에서는 무엇을 규정하고 있나요?"),
    ("paraphrase", "medium", "{L}에서 {T}에 관한 규정은 어떻게 되어 있나요?", "{L}의 {A}에서 정하고 있는 주요 내용이 궁금합니다."),
    ("natural", "hard", "{T}에 대해서 법에서는 어떻게 정하고 있나요?", "{A}에서 정하고 있는 내용이 무엇인지 알려주세요."),
)
ARTICLES_A_LAW, TEMPLATE_ARTICLES = 10, 5


def extract_articles(chunks: DataFrame, fixed_titles: bool = True) -> DataFrame:
    """(law, article, chunk_id, text, title, number): chunks with all fields, each chunk_id once, in order of number."""
    full = chunks.where((F.col("chunk_id") != "") & (F.col("article") != "") & (T.strip(F.col("text")) != ""))
    once = first_of_each(full, ["law", "chunk_id"], ["pos"])
    return once.select("law", "article", "chunk_id", T.strip(F.col("text")).alias("text"), T.evaluation_title(F.col("text"), fixed_titles).alias("title"), T.article_number(F.col("article")).alias("number"), "pos")


def extract_articles_simple(chunks: DataFrame) -> DataFrame:
    """The second generator's rule: an article number is all that is asked for."""
    return chunks.where(F.col("article") != "").select("law", "article", "chunk_id", "text", "pos")


def importance(number: Column, title: Column, text: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Early articles, keywords in the title and the text, neither very short nor very long."""
    words = F.array(*map(F.lit, keywords))
    in_title = F.size(F.filter(words, lambda w: F.contains(title, w)))
    in_text = F.size(F.filter(words, lambda w: F.contains(text, w)))
    band = F.when(number <= 5, 30).when(number <= 10, 15).when(number <= 20, 5).otherwise(0)
    n = F.length(text)
    return band + 15 * in_title + F.least(2 * in_text, F.lit(20)) - F.when(n < 30, 10).otherwise(0) - F.when(n > 2000, 5).otherwise(0)


def select_articles(arts: DataFrame, per_law: int = ARTICLES_A_LAW, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """The most important articles of each law, with their place in order of number."""
    scored = arts.withColumn("importance", importance(F.col("number"), F.col("title"), F.col("text"), keywords))
    best = Window.partitionBy("law").orderBy(F.desc("importance"), "number", "pos")
    kept = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_law).drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("law").orderBy("number", "article", "pos")))


def make_queries(arts: DataFrame) -> DataFrame:
    """Three questions an article: (law, article, chunk_id, place, no, query_type, difficulty, query)."""
    has_title = F.coalesce(F.col("title") != "", F.lit(False))

    def fill(template: str) -> Column:
        x: Column = F.lit(template)
        for mark, c in (("{L}", "law"), ("{A}", "article"), ("{T}", "title")):
            x = F.replace(x, F.lit(mark), F.coalesce(F.col(c), F.lit("")))
        return x

    forms = [F.struct(F.lit(n).alias("no"), F.lit(kind).alias("query_type"), F.lit(level).alias("difficulty"), F.when(has_title, fill(titled)).otherwise(fill(plain)).alias("query")) for n, (kind, level, titled, plain) in enumerate(TEMPLATES)]
    return arts.select("law", "article", "chunk_id", "place", F.explode(F.array(*forms)).alias("f")).select("law", "article", "chunk_id", "place", "f.*")


def number_queries(queries: DataFrame) -> DataFrame:
    """Sequential ids in order of law, place and template.

    Laws are counted first and a law's offset is added to its own numbers, so that no task
    holds all queries; only one row per law meets in one place.
    """
    sizes = queries.groupBy("law").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("law").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = queries.withColumn("nth", F.row_number().over(Window.partitionBy("law").orderBy("place", "no")))
    return own.join(offsets, "law").withColumn("id", F.col("before") + F.col("nth")).drop("before", "nth")


def query_template(arts: DataFrame, per_law: int = TEMPLATE_ARTICLES) -> DataFrame:
    """The first articles of each law with an empty query to fill in."""
    nth = F.row_number().over(Window.partitionBy("law").orderBy("pos"))
    return arts.withColumn("place", nth).where(F.col("place") <= per_law).select("law", "article", "chunk_id", "place", F.lit("").alias("query"))


def valid_query(query: Column) -> Column:
    return F.coalesce((T.strip(query) != "") & (F.length(T.strip(query)) >= 10), F.lit(False))


def apply_corrections(queries: DataFrame, fixes: DataFrame) -> DataFrame:
    """Queries with the columns that a fix of their id replaces; ``fix_question`` also replaces the query."""
    f = fixes.select("id", "action", "new_query", "new_law", "new_article", "new_chunk_id")
    out = queries.join(f, "id", "left")
    query = F.when(F.col("action") == "fix_question", F.coalesce("new_query", "query")).otherwise(F.col("query"))
    pick = lambda new, old: F.coalesce(new, old).alias(old)
    return out.select("id", query.alias("query"), pick("new_law", "expected_law"), pick("new_article", "expected_article"), pick("new_chunk_id", "expected_chunk_id"), F.col("action").isNotNull().alias("corrected"))


def missing_targets(fixes: DataFrame, points: DataFrame) -> DataFrame:
    return fixes.join(points.select(F.col("chunk_id").alias("new_chunk_id")), "new_chunk_id", "left_anti")


def changed_queries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, field, old_value, new_value) of every field that differs."""
    fields = ["query", "expected_law", "expected_article", "expected_chunk_id"]
    o, n = (df.select("id", F.array(*(F.col(c).cast("string") for c in fields)).alias(name)) for df, name in ((old, "o"), (new, "n")))
    rows = o.join(n, "id").select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), "o", "n")).alias("z"))
    return rows.select("id", F.col("z.field").alias("field"), F.col("z.o").alias("old_value"), F.col("z.n").alias("new_value")).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def audit(queries: DataFrame, chunks: DataFrame, chars: int = 200) -> DataFrame:
    """Queries beside the start of their expected chunk; empty where the chunk is missing."""
    known = chunks.select(F.col("chunk_id").alias("expected_chunk_id"), F.col("article").alias("found_article"), "text")
    return queries.join(known, "expected_chunk_id", "left").select("id", "query", "expected_chunk_id", "found_article", T.preview(F.coalesce("text", F.lit("")), chars).alias("preview"))
