"""Validators: each gives the offending rows as (document, check, offending_id); none is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunk import MAX_CHARS, MIN_CHARS

REQUIRED = ("law_name", "section", "article", "chunk_type", "page_start", "page_end", "chunk_index", "chunk_count")


def _report(bad: DataFrame, check: str, id_col: str = "id") -> DataFrame:
    return bad.select(F.col("document").cast("string").alias("document"), F.lit(check).alias("check"), F.col(id_col).cast("string").alias("offending_id"))


def _row_checks(total_pages: Column | None) -> dict[str, Column]:
    nested = F.col("chunk_type") != "article"
    past_end = F.lit(False) if total_pages is None else F.col("page_end") > total_pages
    return {
        "V02": (F.col("section") == "본문") & F.col("chapter").isNull(),
        "V04": (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")) | past_end,
        "V05": F.length("text") < MIN_CHARS,
        "V06": ~F.col("section").isin("본문", "부칙"),
        "V07": ~F.col("chunk_type").isin("article", "paragraph", "item"),
        "V09": F.when(F.col("chunk_type") == "article", F.col("paragraph").isNotNull() | F.col("item").isNotNull()).when(F.col("chunk_type") == "paragraph", F.col("paragraph").isNull() | F.col("item").isNotNull()).otherwise(F.col("item").isNull()),
        "V08a": ~nested & F.col("parent_id").isNotNull() | nested & F.col("parent_id").isNull(),
    }


def row_checks(chunks: DataFrame, total_pages: Column | None = None) -> DataFrame:
    """Checks that need one row only, in one pass: a row per offence."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in _row_checks(total_pages).items())))
    return chunks.select(F.col("document").cast("string").alias("document"), F.explode(found).alias("check"), F.col("id").cast("string").alias("offending_id"))


def missing_keys(chunks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """V03: required columns that the table lacks; a null passes. One row per document and column."""
    lacking = [c for c in required if c not in chunks.columns]
    docs = chunks.select("document").distinct()
    return docs.select(F.col("document").cast("string").alias("document"), F.lit("V03").alias("check"), F.explode(F.array(*map(F.lit, lacking)).cast("array<string>")).alias("offending_id"))


def duplicates(chunks: DataFrame, keys: list[str], check: str) -> DataFrame:
    """V01, V12, V13, V14: keys that occur more than once."""
    twice = chunks.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    label = F.concat_ws("|", *(F.col(k).cast("string") for k in keys if k != "document")).alias("offending_id")
    doc = F.col("document").cast("string") if "document" in keys else F.lit(None).cast("string")
    return twice.select(doc.alias("document"), F.lit(check).alias("check"), label)


def orphans(chunks: DataFrame, of_article: bool = False) -> DataFrame:
    """V08: parents that don't exist; V10: parents that aren't article chunks."""
    parents = chunks.where(F.col("chunk_type") == "article") if of_article else chunks
    kids = chunks.where(F.col("parent_id").isNotNull())
    lost = kids.join(parents.select("document", F.col("id").alias("parent_id")).distinct(), ["document", "parent_id"], "left_anti")
    return _report(lost, "V10" if of_article else "V08")


def oversize(chunks: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    return _report(chunks.where(F.length("text") > size), "V12")


def validate_chunks(chunks: DataFrame, total_pages: Column | None = None) -> DataFrame:
    """All of V01 to V10."""
    parts = [duplicates(chunks, ["document", "id"], "V01"), row_checks(chunks, total_pages), missing_keys(chunks), orphans(chunks), orphans(chunks, True)]
    return reduce(DataFrame.unionByName, parts)


def verdicts(chunks: DataFrame, articles: DataFrame, offences: DataFrame) -> DataFrame:
    """V11: (document, passed, supplement_ok): no offence; a supplement that was found has chunks."""
    bad = offences.groupBy("document").agg(F.count("*").alias("offences"))
    found = articles.groupBy("document").agg(F.max((F.col("section") == "부칙").cast("int")).alias("found"))
    have = chunks.groupBy("document").agg(F.max((F.col("section") == "부칙").cast("int")).alias("have"))
    out = found.join(have, "document", "left").join(bad, "document", "left")
    ok = (F.col("found") == 0) | (F.coalesce("have", F.lit(0)) == 1)
    return out.select("document", (F.coalesce("offences", F.lit(0)) == 0).alias("passed"), ok.alias("supplement_ok"))


def bad_embeddings(points: DataFrame, dim: int) -> DataFrame:
    """V15: no vector, another dimension, or an empty text."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != dim) | (T.strip(F.coalesce("text", F.lit(""))) == "")
    return _report(points.where(bad), "V15", "chunk_id")


def missing_expected(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """V13: queries whose expected chunk isn't there, or that name none."""
    lost = queries.join(chunks.select(F.col("chunk_id").cast("string").alias("expected_chunk_id")).distinct(), "expected_chunk_id", "left_anti")
    return lost.select(F.lit(None).cast("string").alias("document"), F.lit("V13").alias("check"), F.col("id").cast("string").alias("offending_id"))


def missing_fields(queries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, field) of required fields that are null or empty."""
    lacking = F.array_compact(F.array(*(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields)))
    return queries.select("id", F.explode(lacking).alias("field"))


def observed(df: DataFrame, name: str, checks: dict[str, Column]):
    """``df`` with counts of each check observed while it is used, and the observation."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *(F.count_if(c).alias(k) for k, c in checks.items())), seen
