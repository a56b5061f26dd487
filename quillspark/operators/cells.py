"""Dense search over stored cells: points lie in folders by law and cell of a trained codebook.

A query probes the cells whose directions are nearest to its own: the reader gets their folders
by dynamic partition pruning and skips the others. Points of probed cells get exact cosines. For
a cell of radius r (the largest angle of a point to the cell's direction) no point's cosine is
above cos(max(0, angle(query, cell) - r)); so after the first probes only cells whose bound
reaches a query's k-th score are left, and with ``certified`` those are probed too: the rows are
then those of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StringType, StructField, StructType

from ..storage import staged
from .dense import BROADCAST_QUERIES, block_hits, dot, has_direction, norm

CELLS, PROBES = 64, 8
#: Rows that the codebook is trained on (those of the least hashed ids), and rounds of k-means.
TRAIN_ROWS, ROUNDS = 16_384, 10
#: Pairs of query and probed cell that a search sends to the tasks at once.
PROBED_PAIRS = 1_000_000
#: Room for rounding in bounds.
ROOM = 1e-9


def directions(v: np.ndarray, cells: int = CELLS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors in the middle of groups of the rows of ``v``."""
    unit = np.unique(v / np.linalg.norm(v, axis=1, keepdims=True), axis=0)
    out = unit[np.sort(np.random.default_rng(5).permutation(len(unit))[:cells])]
    for _ in range(rounds):
        own = np.argmax(unit @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), out)
    return out


def with_direction(points: DataFrame) -> DataFrame:
    """Points whose vector has one: not null, not zero, all components finite."""
    v = F.col("embedding")
    return points.where(F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))


def _assign(middle: np.ndarray):
    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.stack(part.to_numpy()).astype(np.float64) if len(part) else np.empty((0, middle.shape[1]))
            near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ middle.T
            cell = np.argmax(near, axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))})

    return nearest


@dataclass
class Cells:
    """A stored index: ``points`` by law and cell, ``cells`` (law, cell, n, radius, middle)."""

    path: str

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/points")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def build(spark: SparkSession, path: str, points: DataFrame, cells: int = CELLS, train_rows: int = TRAIN_ROWS) -> Cells:
    """Store ``points`` (chunk_id, law, embedding) by law and cell. Those without a direction are left out; a null law is a law."""
    good = with_direction(points.select("chunk_id", "law", "embedding"))
    train = good.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(train_rows).select("embedding").toPandas()  # bounded
    if train.empty:
        raise ValueError("no points to train cells on")
    middle = directions(np.stack(train["embedding"].to_numpy()).astype(np.float64), cells)
    placed = good.withColumn("at", _assign(middle)("embedding")).select("chunk_id", F.col("law").alias("law_"), "embedding", "law", "at.cell", "at.angle")
    # a cell that holds much of a law is cut by hashed id
    placed.repartitionByRange("law", "cell", F.xxhash64("chunk_id")).write.partitionBy("law", "cell").parquet(f"{path}/points")
    book = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(middle)], "cell int, middle array<double>")
    stored = spark.read.parquet(f"{path}/points")
    sizes = stored.groupBy("law", "law_", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes.join(F.broadcast(book), "cell").coalesce(1).write.parquet(f"{path}/cells")  # a row a law and cell
    return Cells(path)


def _bound(angle: Column, radius: Column) -> Column:
    return F.cos(F.greatest(F.lit(0.0), angle - radius - F.lit(ROOM)))


def _ranked_cells(queries: DataFrame, cells: DataFrame, by_law: bool | None) -> DataFrame:
    """(qid, law, cell, n, bound, nth): each query's cells, the nearest direction first. Cells are broadcast: a row a law and cell."""
    q = queries.select("qid", F.col("law").alias("q_law"), F.transform("embedding", lambda x: x.cast("double")).alias("qv")).withColumn("qn", norm(F.col("qv")))
    same = F.col("q_law") == F.col("law_")
    on = same if by_law else F.lit(True) if by_law is False else F.col("q_law").isNull() | same
    met = with_direction(q.withColumn("embedding", F.col("qv"))).drop("embedding").join(F.broadcast(cells), on)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("qv"), F.col("middle")) / F.col("qn"))))
    met = met.withColumn("angle", angle).select("qid", "law", "cell", "n", "angle", _bound(F.col("angle"), F.col("radius")).alias("bound"))
    nearest = Window.partitionBy("qid").orderBy("angle", "law", "cell")
    return met.withColumn("nth", F.row_number().over(nearest)).select("qid", "law", "cell", "n", "bound", "nth")


def _pairs(points: DataFrame, probed: DataFrame, queries: DataFrame, exclude_self: bool) -> DataFrame:
    """Every pair of a query and a point of its probed cells; ``probed`` (qid, law, cell) is broadcast with the vectors in groups."""
    points = points.withColumn("pv", F.transform("embedding", lambda x: x.cast("double"))).withColumn("pn", norm(F.col("pv")))
    vectors = queries.select("qid", F.transform("embedding", lambda x: x.cast("double")).alias("qv")).withColumn("qn", norm(F.col("qv")))
    probed = probed.join(vectors, "qid")
    groups, hits = ceil(probed.count() / BROADCAST_QUERIES) or 1, None
    for g in range(groups):
        own = probed if groups == 1 else probed.where(F.pmod(F.xxhash64("qid", "cell"), F.lit(groups)) == g)
        own = own.select("qid", "qv", "qn", F.col("law").alias("c_law"), F.col("cell").alias("c_cell"))
        met = points.join(F.broadcast(own), (F.col("cell") == F.col("c_cell")) & F.col("law").eqNullSafe(F.col("c_law")))
        if exclude_self:
            met = met.where(F.col("qid") != F.col("chunk_id"))
        met = met.select("qid", "chunk_id", F.col("law_").alias("law"), (dot(F.col("qv"), F.col("pv")) / (F.col("qn") * F.col("pn"))).alias("score"))
        hits = met if hits is None else hits.unionByName(met)
    return hits


def _blocks(points: DataFrame, probed: DataFrame, queries: DataFrame, dim: int, k: int, exclude_self: bool) -> DataFrame:
    """Blocks of scores of each probed cell; ``probed`` goes through the driver: ``PROBED_PAIRS`` of it."""
    spark = points.sparkSession
    rows = queries.select("qid", F.transform("embedding", lambda x: x.cast("double")).alias("qv")).toArrow()
    vectors = rows.column("qv").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dim)
    qids = rows.column("qid").to_pylist()
    own = pd.DataFrame({"qid": pd.Series(qids, dtype=object), "row": np.arange(len(qids))})
    named = probed.select("law", "cell").distinct().collect()  # a row a law and cell
    keys = spark.createDataFrame([(r.law, r.cell, key) for key, r in enumerate(named)], StructType([*probed.select(F.col("law").alias("c_law"), F.col("cell").alias("c_cell")).schema, StructField("key", IntegerType())])).where("key >= 0")
    same = (F.col("cell") == F.col("c_cell")) & F.col("law").eqNullSafe(F.col("c_law"))
    met = probed.join(F.broadcast(keys), same).select("qid", "key").toArrow()
    met = pd.DataFrame({"qid": pd.Series(met.column("qid").to_pylist(), dtype=object), "key": met.column("key").to_numpy()}).merge(own, "inner", "qid")
    asked = {int(key): np.unique(x.to_numpy()) for key, x in met.groupby("key")["row"]}
    p = points.join(F.broadcast(keys), same).select("key", "chunk_id", F.col("law_").alias("law"), "embedding")
    return block_hits(p, vectors, qids, queries.schema["qid"].dataType, asked, k, exclude_self)


def _scored(index: Cells, spark: SparkSession, probed: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k best points of each query in its probed cells. Odd ids and vectors are scored pair by pair."""
    points, dim = index.points(spark), index.cells(spark).agg(F.max(F.size("middle"))).first()[0]
    kinds = [queries.schema["qid"].dataType, points.schema["chunk_id"].dataType]
    plain = any(all(isinstance(t, kind) for t in kinds) for kind in (IntegralType, StringType))
    good, usual = (F.col("qid").isNotNull() & has_direction(F.col("embedding"), dim), F.col("chunk_id").isNotNull() & has_direction(F.col("embedding"), dim)) if plain else (F.lit(False), F.lit(False))
    parts, some = [], queries.where(good)
    if not queries.where(~good).isEmpty():
        parts.append(_pairs(points, probed, queries.where(~good), exclude_self))
    if plain:
        if not points.where(~usual).isEmpty():
            parts.append(_pairs(points.where(~usual), probed, some, exclude_self))
            points = points.where(usual)
        groups = ceil(probed.count() / PROBED_PAIRS) or 1
        for g in range(groups):
            one = lambda df: df if groups == 1 else df.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g)  # noqa: B023,E731
            parts.append(_blocks(points, one(probed), one(some), dim, k, exclude_self))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)


@dataclass
class Found:
    """Hits (qid, dense_rank, chunk_id, law, score), and which cells of which queries were probed (qid, law, cell, n)."""

    hits: DataFrame
    probed: DataFrame


def search(spark: SparkSession, index: Cells, queries: DataFrame, k: int = 5, by_law: bool | None = None, probes: int = PROBES, certified: bool = False, exclude_self: bool = False) -> Found:
    """``dense.dense_top_k`` over each query's ``probes`` nearest cells, or with ``certified`` over all that may hold a hit.

    Points without a direction aren't stored and queries without one have no hits.
    """
    asking = with_direction(queries.select("qid", "embedding"))
    cells = staged(_ranked_cells(queries, index.cells(spark), by_law), "query-cells")
    probed = cells.where(F.col("nth") <= probes)
    hits = _scored(index, spark, probed, asking, k, exclude_self)
    if certified:
        hits = staged(hits, "first-hits")
        kth = hits.where(F.col("dense_rank") == k).select("qid", F.col("score").alias("kth"))
        rest = cells.where(F.col("nth") > probes).join(kth, "qid", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - ROOM)).drop("kth")
        rest = staged(rest, "later-cells")
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
        both = hits.unionByName(_scored(index, spark, rest, asking, k, exclude_self)).drop("dense_rank")
        hits = both.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)
        probed = probed.unionByName(rest)
    return Found(hits.select("qid", "dense_rank", "chunk_id", "law", "score"), probed.select("qid", "law", "cell", "n"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (qid, chunk_id) that were found; 1 if there are none."""
    n = exact.count()
    return exact.join(found.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").count() / n if n else 1.0


def share_read(spark: SparkSession, index: Cells, found: Found, queries: DataFrame) -> float:
    """Points that a query met, of all points, on average."""
    total = index.cells(spark).agg(F.sum("n")).first()[0]
    return (found.probed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) / (total * max(1, queries.count()))
