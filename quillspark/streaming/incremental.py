"""Incremental indexing as a stream: each micro-batch adds what the index doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import collection as K
from ..operators.index import new_only, with_point_id


def index_stream(chunks: DataFrame, index_path: str, checkpoint: str, embedder) -> DataStreamWriter:
    """A writer that embeds and appends new chunk_ids of a chunk stream to a Parquet index.

    A batch that is run again after a failure finds its rows indexed and adds none; within
    a batch one row of each chunk_id stays.
    """
    empty = chunks.sparkSession.createDataFrame([], "chunk_id string")

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(index_path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        known = spark.read.parquet(index_path) if there else empty
        fresh = new_only(batch.dropDuplicates(["chunk_id"]), known)
        with_point_id(fresh.withColumn("embedding", embedder("text"))).write.mode("append").parquet(index_path)

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)


def collection_stream(chunks: DataFrame, table: str, checkpoint: str, embedder, order: str = "load_seq", replace: bool = False) -> DataStreamWriter:
    """A writer of a chunk stream (chunk_id, text, ...) to a stored collection, each row once.

    A batch's number is committed with its rows and it reads only its own buckets. A batch
    that was killed after it wrote is run again by the stream: its rows are found and it adds
    none. With ``replace`` known ids get the batch's rows instead.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if replace:
            K.upsert_into(spark, table, batch.withColumn("embedding", embedder(F.col("text"))), number, order)
        else:
            K.add_new(spark, table, batch, embedder, number, order)

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
