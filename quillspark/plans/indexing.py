"""The point table: scans, flattened payloads, keys, upserts and incremental loads."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions.text import URL_NAMESPACE
from ..operators import chunk as C
from ..operators import collection as K
from ..operators import index as I
from ..operators import validate as V
from ..storage import shared_folder, staged
from .registry import query, table
from .statutes import CHUNKS, statute_chunks, with_sql
from .texts import _UUID5


def load(spark, sf_dir):
    """Vectors as a load with repeated ids: every fifth comes twice, the second time scaled."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("law"), "embedding", F.col("vec_id").alias("n"))
    again = rows.where("n % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    return rows.withColumn("load_seq", F.lit(1)).unionByName(again.withColumn("load_seq", F.lit(2)))


def indexed(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0")
    return rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("old").alias("law"), "embedding", F.col("vec_id").alias("n"), F.lit(0).alias("load_seq"))


@query("S10_filtered_scan", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def filtered_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").where("label = 3")


@query("S11_existing_ids", "SELECT DISTINCT source AS chunk_id FROM documents WHERE source IS NOT NULL AND source <> ''")
def existing_ids(spark, sf_dir):
    return I.existing_ids(table(spark, sf_dir, "documents").withColumn("chunk_id", F.col("source")))


@query("S13_existing_rows", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def existing_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents"), "doc_id", "left_semi")


@query("S14_collection_size", "SELECT count(*) AS points, count(DISTINCT label) AS laws FROM embeddings")
def collection_size(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("points"), F.count_distinct("label").alias("laws"))


@query("K02_wrong_dimension", "SELECT vec_id, len(CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] ELSE embedding END)::INT AS dim FROM embeddings WHERE vec_id % 7 = 0")
def wrong_dimension(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return I.wrong_dimension(rows, 64).select("vec_id", F.size("embedding").alias("dim"))


@query("K03_create_collection", "SELECT vec_id::VARCHAR AS chunk_id FROM embeddings WHERE vec_id % 3 = 0")
def create_collection(spark, sf_dir):
    name = "points_" + shared_folder(spark, "t").rsplit("-", 1)[1]
    I.create_collection(spark, name)
    I.create_collection(spark, name)
    fresh = I.with_point_id(indexed(spark, sf_dir)).select("id", "chunk_id", "law", F.lit("").alias("text"), "embedding")
    fresh.write.insertInto(name)
    out = staged(spark.table(name).select("chunk_id"), "collection")
    spark.sql(f"DROP TABLE {name}")
    return out


UPSERT = "SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS law, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END::INT AS load_seq, round((CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END) * embedding[1]::DOUBLE, 5) AS first FROM embeddings"


@query("U01_K04_upsert", UPSERT)
def upsert(spark, sf_dir):
    out = I.upsert(I.with_point_id(indexed(spark, sf_dir)), I.with_point_id(load(spark, sf_dir)))
    return out.select("chunk_id", "law", "load_seq", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


@contextmanager
def own_collection(spark, dim=64, buckets=8):
    """A collection of its own, dropped at the end."""
    folder = shared_folder(spark, "collection")
    name = "points_" + folder.rsplit("-", 1)[1]
    K.create(spark, name, dim, buckets, "id string, chunk_id string, law string, embedding array<float>, load_seq int, batch long", folder)
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")


@query("U01_K02_collection_upsert", UPSERT.replace("AS load_seq", "AS load_seq, 1::BIGINT AS batch"))
def collection_upsert(spark, sf_dir):
    """A first load, then one with repeated ids over it, in a table of eight buckets."""
    with own_collection(spark) as name:
        K.upsert_into(spark, name, indexed(spark, sf_dir), 0)
        K.upsert_into(spark, name, load(spark, sf_dir), 1)
        out = staged(K.points(spark, name), "points")
    return out.select("chunk_id", "law", "load_seq", "batch", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


@query("K02_rejected_load", "SELECT vec_id::VARCHAR AS chunk_id, 'old' AS law, 0::BIGINT AS batch, true AS rejected FROM embeddings WHERE vec_id % 3 = 0")
def rejected_load(spark, sf_dir):
    """A load in which every seventh vector lacks an entry: refused, and the collection is as before."""
    with own_collection(spark) as name:
        K.upsert_into(spark, name, indexed(spark, sf_dir), 0)
        short = load(spark, sf_dir).withColumn("embedding", F.when(F.col("n") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
        try:
            K.upsert_into(spark, name, short, 1)
            rejected = False
        except ValueError:
            rejected = True
        out = staged(K.points(spark, name), "points")
    return out.select("chunk_id", "law", "batch", F.lit(rejected).alias("rejected"))


@query("K05_K06_stream_batches", f"SELECT {_UUID5} AS id, doc_id::VARCHAR AS chunk_id, source AS law, 64::INT AS dim FROM (SELECT doc_id, source, sha1(unhex('{URL_NAMESPACE}') || encode(doc_id::VARCHAR)) AS h FROM documents)")
def stream_batches(spark, sf_dir):
    """Documents as a stream of files, in which every fourth comes again; the last batch is run twice."""
    from ..streaming.incremental import collection_stream
    from .retrieval import doc_chunks, hashed_embedding

    chunks = doc_chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), "law", "text", F.col("chunk_id").cast("int").alias("load_seq"))
    folder, memory = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    chunks.where("load_seq % 2 = 0").write.parquet(folder)
    with own_collection(spark) as name:
        for part in ("load_seq % 2 = 1", "load_seq % 4 = 0"):
            source = spark.readStream.schema(chunks.schema).parquet(folder)
            collection_stream(source, name, memory, hashed_embedding).trigger(availableNow=True).start().awaitTermination()
            chunks.where(part).write.mode("append").parquet(folder)
        K.add_new(spark, name, chunks, hashed_embedding, 1)
        K.add_new(spark, name, chunks, hashed_embedding, 1)
        out = staged(K.points(spark, name), "points")
    return out.select("id", "chunk_id", "law", F.size("embedding").alias("dim"))


@query("K04_embed_and_upsert", f"SELECT {_UUID5} AS id, doc_id::VARCHAR AS chunk_id, 64::INT AS dim, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS law FROM (SELECT doc_id, sha1(unhex('{URL_NAMESPACE}') || encode(doc_id::VARCHAR)) AS h FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0)")
def embed_and_upsert(spark, sf_dir):
    from .retrieval import doc_chunks, hashed_embedding

    chunks = doc_chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.col("chunk_id").alias("load_seq"))
    old = staged(I.with_point_id(chunks.where("load_seq % 3 = 0").withColumns({"law": F.lit("old"), "embedding": hashed_embedding("text")})), "points")
    out = I.embed_and_upsert(old, chunks.where("load_seq % 4 = 0").withColumn("law", F.lit("new")), hashed_embedding, 64)
    return out.select("id", "chunk_id", F.size("embedding").alias("dim"), "law")


@query("F02_K06_new_only", "SELECT vec_id::VARCHAR AS chunk_id FROM embeddings WHERE vec_id % 3 <> 0")
def new_only(spark, sf_dir):
    return I.new_only(load(spark, sf_dir), indexed(spark, sf_dir)).select("chunk_id").distinct()


@query("K05_K06_incremental_load", f"SELECT {_UUID5} AS id, doc_id::VARCHAR AS chunk_id, source AS law, 64::INT AS dim FROM (SELECT doc_id, source, sha1(unhex('{URL_NAMESPACE}') || encode(doc_id::VARCHAR)) AS h FROM documents)")
def incremental_load(spark, sf_dir):
    from .retrieval import doc_chunks, hashed_embedding

    chunks = doc_chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), "law", "text", F.col("chunk_id").alias("load_seq"))
    old = staged(I.with_point_id(chunks.where("load_seq % 3 = 0").withColumn("embedding", hashed_embedding("text"))), "points")
    out = I.incremental_load(chunks, old, hashed_embedding)
    return out.select("id", "chunk_id", "law", F.size("embedding").alias("dim"))


@query("T11_flat_payload", with_sql(CHUNKS, "SELECT id AS chunk_id, text, law_name, section, chapter, subsection, article, article_title, page_start, page_end, document || '.pdf' AS file, law_name AS law FROM chunks"))
def flat_payload(spark, sf_dir):
    return I.flatten_payload(C.nested_chunks(statute_chunks(spark, sf_dir))).select("chunk_id", "text", "law_name", "section", "chapter", "subsection", "article", "article_title", "page_start", "page_end", "file", "law")


@query("V15_bad_embeddings", "SELECT label::VARCHAR AS document, 'V15' AS \"check\", vec_id::VARCHAR AS offending_id FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 = 0")
def bad_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("document"), F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 7 == 0, " ").otherwise("x").alias("text"))
    return V.bad_embeddings(rows, 64)
