"""A stored collection of points: a table bucketed by id, whose properties hold its dimension.

A write stages its load, checks it against the dimension, reads the buckets that the load's ids
fall in, and overwrites just those partitions. Spark writes all new files first and swaps
partitions in when the job commits: a load that fails changes nothing, and files of other
buckets stay as they are. Rows carry the number of the batch that wrote them, in the same commit;
a batch that runs again finds its rows there.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import staged
from .index import with_point_id, wrong_dimension

BUCKETS = 64
COLUMNS = "id string, chunk_id string, law string, text string, embedding array<float>, batch long"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def create(spark: SparkSession, table: str, dim: int, buckets: int = BUCKETS, columns: str = COLUMNS, location: str | None = None) -> None:
    """Create the collection if it isn't there; one of another dimension is an error and stays as it is."""
    if not spark.catalog.tableExists(table):
        at = f"LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE {table} ({columns}, bucket int) USING parquet PARTITIONED BY (bucket) {at} TBLPROPERTIES ('dimension' = '{int(dim)}', 'buckets' = '{int(buckets)}')")
    if properties(spark, table)[0] != dim:
        raise ValueError(f"{table} has vectors of {properties(spark, table)[0]} dimensions, not {dim}")


def properties(spark: SparkSession, table: str) -> tuple[int, int]:
    """(dimension, buckets) of a collection."""
    kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return int(kept["dimension"]), int(kept["buckets"])


def _table(spark: SparkSession, table: str) -> DataFrame:
    """The table with the files that it has now: another session (a stream's) may have written since."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def bucket_of(ident: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")


def points(spark: SparkSession, table: str, ids: DataFrame | None = None) -> DataFrame:
    """The collection's rows; with ``ids`` (id) those of its buckets only, which the reader skips by partition."""
    rows = _table(spark, table)
    if ids is None:
        return rows.drop("bucket")
    touched = _buckets(ids.select(bucket_of(F.col("id"), properties(spark, table)[1]).alias("bucket")))
    return rows.where(F.col("bucket").isin(touched)).drop("bucket")


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # as many as the table has at most


@contextmanager
def _dynamic(spark: SparkSession):
    before = spark.conf.get(_OVERWRITE, None)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_OVERWRITE, before) if before else spark.conf.unset(_OVERWRITE)


def _checked(spark: SparkSession, table: str, load: DataFrame, order: str) -> tuple[DataFrame, list[int]]:
    """The load staged with its buckets, one row an id (the last by ``order``); an error if a vector is missing or misshapen."""
    dim, buckets = properties(spark, table)
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last(order))
    rows = with_point_id(load).withColumn("bucket", bucket_of(F.col("id"), buckets))
    rows = staged(rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth"), "load")
    bad = wrong_dimension(rows, dim).select("chunk_id").limit(5).collect()
    if bad:
        raise ValueError(f"{table} takes vectors of {dim} dimensions; not those of {[r.chunk_id for r in bad]}")
    return rows, _buckets(rows)


def upsert_into(spark: SparkSession, table: str, load: DataFrame, batch: int = 0, order: str = "load_seq") -> list[int]:
    """Write ``load`` (chunk_id, ..., embedding, ``order``), the last row of an id winning; the buckets that were rewritten.

    Rows of a later batch than ``batch`` stay: a batch that is run again doesn't undo what came after it.
    """
    rows, touched = _checked(spark, table, load, order)
    columns = [c for c in _table(spark, table).columns if c != "bucket"]
    new = rows.withColumn("batch", F.lit(batch).cast("long"))
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns), "bucket", F.lit(1).alias("_new"))
    old = _table(spark, table).where(F.col("bucket").isin(touched)).select(*columns, "bucket", F.lit(0).alias("_new"))
    last = Window.partitionBy("bucket", "id").orderBy(F.desc("batch"), F.desc("_new"))
    merged = old.unionByName(new).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "_new")
    merged = staged(merged, "merged")  # a table can't be read and overwritten by one job
    with _dynamic(spark):
        merged.repartition("bucket").write.mode("overwrite").insertInto(table)
    return touched


def add_new(spark: SparkSession, table: str, load: DataFrame, embedder, batch: int = 0, order: str = "load_seq") -> int:
    """Embed and write those rows of ``load`` (chunk_id, text, ...) whose id isn't there; their number.

    Only the load's own buckets are read. What the batch wrote before it was killed is there
    already, so running it again embeds and adds the rest.
    """
    buckets = properties(spark, table)[1]
    keyed = staged(with_point_id(load), "keyed")
    touched = _buckets(keyed.select(bucket_of(F.col("id"), buckets).alias("bucket")))
    known = _table(spark, table).where(F.col("bucket").isin(touched)).select("id")
    fresh = keyed.join(known, "id", "left_anti").drop("id")
    rows, _ = _checked(spark, table, fresh.withColumn("embedding", embedder(F.col("text"))), order)
    n = rows.count()
    if n:
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        columns = _table(spark, table).columns
        rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns))
        rows.repartition("bucket").write.insertInto(table)
    return n


def last_batch(spark: SparkSession, table: str) -> int | None:
    """The number of the latest batch that wrote rows which are still there."""
    return _table(spark, table).agg(F.max("batch")).first()[0]
