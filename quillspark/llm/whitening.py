"""Whitening of embeddings by distributed block matrices (Spark MLlib).

Centred rows are indexed into blocks of rows; the transpose times the matrix is the scatter, with
the products of many blocks summed in splits of the long side, so that no task gets all blocks;
its eigenvectors are taken locally (a matrix of dimensions, never of rows), and one more block
product with the whitening matrix projects the rows. Sums, counts and deviations are exact.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .shared import discard, staged
from .vectors import SCALE, usable

#: Rows of a block, and blocks whose products one task sums at most.
BLOCK_ROWS, TASK_BLOCKS = 512, 16
#: Components with less than this share of the variance have none.
LEAST_SHARE = 1e-12


def numbered(df: DataFrame) -> DataFrame:
    """``df``, staged, with ``index`` 0, 1, 2, ... by offsets of its parts."""
    placed = staged(df.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))  # a row a part
    out = placed.join(F.broadcast(offsets), "part_").withColumn("index", F.col("before_") + F.col("at_")).drop("part_", "at_", "n_", "before_")
    out.staged_path = placed.staged_path
    return out


def _blocks(rows: DataFrame, centre: list[float], n: int) -> BlockMatrix:
    """(index, x) -> blocks of centred rows, all columns in one block.

    Kept while products read them several times; parts that get lost are made again.
    """
    mean = F.array(*(F.lit(c) for c in centre))
    centred = F.zip_with(F.col("x"), mean, lambda x, m: x.cast("double") - m)
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(frame, n, len(centre)).toBlockMatrix(BLOCK_ROWS, len(centre)).persist(StorageLevel.MEMORY_AND_DISK)


def _release(blocks: BlockMatrix) -> None:
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix; the long side is split, so that a task sums TASK_BLOCKS products."""
    splits = ceil(ceil(blocks.numRows() / BLOCK_ROWS) / TASK_BLOCKS)
    turned = blocks.transpose()._java_matrix_wrapper
    product = turned.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _times(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    d, k = matrix.shape
    right = IndexedRowMatrix(spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(matrix)], ["index", "vector"]).coalesce(1), d, k).toBlockMatrix(d, k)
    product = blocks._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model)
    return BlockMatrix(product, BLOCK_ROWS, k)


def _indexed(blocks: BlockMatrix) -> DataFrame:
    """(index, z array<double>) of a block matrix's rows; stays in the JVM."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("z"))


_EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and its first components.

    ``vectors``: vec_id, embedding; a component c counts as x = floor(256 c), in double
    precision. The covariance V is that of the distinct x vectors, n of them with sums S,
    centred, with divisor n; components are its unit eigenvectors by falling eigenvalue e.
    deviation: the sum of (n x - S)^2, exact, null where it is beyond long. whitened:
    (x - S / n) on the component by sqrt(e), null where e is no more than LEAST_SHARE of the
    trace (an x that never changes, fewer vectors than dimensions); explained: e by the trace,
    0 where that is 0. identity_error: the largest entry of the covariance of the whitened
    distinct vectors minus the identity, over components that aren't null (null without any).

    Vectors that are null or empty or hold null or non-finite components are dropped; if the
    others differ in length, so are those not of the commonest length (of the longer, at a
    tie). Null and repeated vec_ids are rows like others. An empty table gives an empty one;
    other columns aren't used. Scaled components beyond long count as its ends; those beyond
    2^53 are rounded to doubles in the products.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & (F.size("embedding") > 0))
    size = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], _EMPTY)
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    rows = numbered(good.where(F.size("embedding") == size.d).select("vec_id", x.alias("x")))
    fit = numbered(rows.select("x").distinct())
    n = fit.count()
    sums = dict(fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect())  # a row a dimension
    total = [int(sums[k]) for k in range(size.d)]
    centre = [float(s) / n for s in total]

    fitted = _blocks(fit, centre, n)
    e, u = np.linalg.eigh(_scatter(fitted) / n)
    e, u = e[::-1].clip(0), u[:, ::-1]
    trace, k = float(e.sum()), min(components, size.d)
    alive = [c for c in range(k) if e[c] > LEAST_SHARE * trace]
    explained = [float(e[c]) / trace if trace else 0.0 for c in range(k)]

    # (n x - S)^2 summed: n^2 x.x - 2 n x.S + S.S, in decimals that hold any long's square
    wide, s = "decimal(38,0)", F.array(*(F.lit(t).cast("decimal(38,0)") for t in total))
    own = F.aggregate(F.col("x"), F.lit(0).cast(wide), lambda a, v: (a + (v.cast("decimal(19,0)") * v.cast("decimal(19,0)"))).cast(wide))
    cross = F.aggregate(F.zip_with("x", s, lambda v, t: (v.cast(wide) * t).cast(wide)), F.lit(0).cast(wide), lambda a, v: (a + v).cast(wide))
    out = rows.select("index", "vec_id", own.alias("own"), cross.alias("cross"))
    deviation = F.expr(f"try_cast(try_add(try_subtract(try_multiply(own, cast({n * n} as decimal(38,0))), try_multiply(cross, cast({2 * n} as decimal(38,0)))), cast({sum(t * t for t in total)} as decimal(38,0))) as long)")
    error = every = None
    if alive:
        w = u[:, alive] / np.sqrt(e[alive])
        error = float(np.abs(_scatter(_times(spark, fitted, w)) / n - np.eye(len(alive))).max())
        every = _blocks(rows, centre, rows.count())
        z = _indexed(_times(spark, every, w))
        out = out.join(z, "index")
    else:
        out = out.withColumn("z", F.array().cast("array<double>"))
    each = F.explode(F.array(*(F.struct(F.lit(c + 1).alias("component"), (F.get("z", F.lit(alive.index(c))) if c in alive else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[c]).alias("explained")) for c in range(k))))
    out = out.select("vec_id", deviation.alias("deviation"), each.alias("c")).select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
    out = staged(out, "whitened")
    for kept in (fitted, every):
        if kept is not None:
            _release(kept)
    for used in (rows, fit):
        discard(used)
    return out
