"""The point table: flattened payloads, deterministic keys, upserts and incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import staged


def flatten_payload(chunks: DataFrame) -> DataFrame:
    """Nested chunks (id, text, metadata) -> flat columns with chunk_id and law.

    The nested source's fields replace those of the same name.
    """
    fields = chunks.schema["metadata"].dataType.fieldNames()
    inner = chunks.schema["metadata"].dataType["source"].dataType.fieldNames() if "source" in fields else []
    flat = [F.col(f"metadata.source.{c}").alias(c) if c in inner else F.col(f"metadata.{c}").alias(c) for c in fields if c != "source"]
    extra = [F.col(f"metadata.source.{c}").alias(c) for c in inner if c not in fields]
    return chunks.select(F.col("id").alias("chunk_id"), "text", *flat, *extra, T.short_law_name(F.col("metadata.law_name")).alias("law"))


def with_point_id(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    return df.withColumn("id", T.uuid5(F.col(key)))


def upsert(existing: DataFrame, load: DataFrame, order: str = "load_seq", key: str = "id") -> DataFrame:
    """The union, the last row of each key by ``order``; loaded rows come after existing ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(load.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last(order))
    return both.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "_new")


def existing_ids(points: DataFrame, key: str = "chunk_id") -> DataFrame:
    return points.select(key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()


def new_only(load: DataFrame, points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key isn't indexed yet; the costly embedding then runs on those alone."""
    return load.join(existing_ids(points, key), key, "left_anti")


def incremental_load(load: DataFrame, points: DataFrame, embedder) -> DataFrame:
    """Embed what is new and add it: one row per key, the last of the load."""
    fresh = new_only(load, points)
    return upsert(points, with_point_id(fresh.withColumn("embedding", embedder(F.col("text")))))


def embed_and_upsert(existing: DataFrame, load: DataFrame, embedder, dim: int) -> DataFrame:
    """Embed all of ``load``, check the vectors, then upsert: a load with a missing or misshapen vector changes nothing.

    The vectors are staged, so the check and the upsert read one computation.
    """
    points = staged(with_point_id(load.withColumn("embedding", embedder(F.col("text")))), "embedded")
    seen = points.agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") != dim)).alias("bad")).first()
    expected = load.count()
    if seen.n != expected or seen.bad:
        raise ValueError(f"{seen.n} vectors for {expected} chunks, {seen.bad} of them not of {dim} dimensions")
    return upsert(existing, points)


def counts_by_law(points: DataFrame) -> DataFrame:
    return points.groupBy(F.coalesce("law", F.lit("MISSING")).alias("law")).agg(F.count("*").alias("n"))


def create_collection(spark: SparkSession, table: str, columns: str = "id string, chunk_id string, law string, text string, embedding array<float>") -> None:
    """Create the table if it isn't there; never drop one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def wrong_dimension(points: DataFrame, dim: int) -> DataFrame:
    """Points that a collection of ``dim`` dimensions rejects."""
    return points.where(F.col("embedding").isNull() | (F.size("embedding") != dim))
