"""Helpers of the operators here: shared folders, staged tables, files in any store.

Everything that one task writes and another task (or the driver) reads goes below the
folder named by ``spark.checkpoint.dir``, never to a machine-local temporary folder.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import drop_idle

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_root[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is staged, at most: ten thousand whole texts take tens of MB on either side of a worker's pipe.
BATCH_ROWS = 1000


@contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if 0 < before <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Cuts the lineage: an executor lost later costs no recomputation of ``df``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a sieve: so many for each key, and at most.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 26


def sifted(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` whose ``col`` may be among those of ``keys``: all that are, and few others.

    For a join of a large table with a smaller one that is too large to be broadcast: only what
    passes needs to be shuffled. Bits of the keys' hashes are broadcast, 8 MB at most; where there are
    so many keys that most bits are set, all rows pass. ``keys`` should be staged, as it is read twice.
    """
    bits = min(MOST_SIEVE_BITS, 1 << max(15, (SIEVE_BITS * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(col), F.lit(bits)) + 1
    at = keys.select(F.bitmap_bucket_number(place).alias("sieve"), F.bitmap_bit_position(place).alias("bit"))
    # dealt first: a task then makes whole maps, not one of each
    maps = at.repartition("sieve").groupBy("sieve").agg(F.bitmap_construct_agg("bit").alias("map"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("sieve", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "sieve")
    return met.where(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1).select(*quoted(rows.columns))


def split_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; a bare path is local (or a mounted share)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then move it to its own."""
    store, path = split_uri(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def batches_of(it, max_rows: int = 512):
    """Cut incoming Arrow batches to slices of at most ``max_rows`` rows.

    Spark keeps the worker process for later tasks of any operator: what these don't need is given back.
    """
    drop_idle()
    for batch in it:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)
    pa.default_memory_pool().release_unused()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever dots or backticks the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
