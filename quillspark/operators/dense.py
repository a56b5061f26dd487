"""Exact dense retrieval: query vectors against a table of points."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, StringType, StructField, StructType

#: Queries that are broadcast at once, about: their vectors are the small side of the product.
BROADCAST_QUERIES = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def embed(texts: DataFrame, embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Add vectors by a pluggable Arrow UDF: string column -> array<float>."""
    return texts.withColumn(out, embedder(F.col(text_col)))


#: Bounds of the components that the blocks of scores take: no square or product leaves the doubles.
MOST, LEAST = 1e70, 1e-70
#: Points and queries of a block of scores: some tens of MB. Pairs that get exact scores at once.
BLOCK_POINTS, BLOCK_QUERIES, BLOCK_PAIRS = 4096, 1024, 1 << 16
#: Room for rounding in a block's scores.
ROOM = 1e-9


def has_direction(v: Column, dim: int) -> Column:
    """Whether vectors have ``dim`` components, all of them finite and of usual size, some not zero."""
    usual = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < MOST)) & F.exists(v, lambda x: F.abs(x) > LEAST)
    return F.coalesce((F.size(v) == dim) & usual, F.lit(False))


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in order as the SQL does, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _least_ids(keys: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that can't be among k best: of equal vectors only the k + 1 smallest ids matter (one may be the query's own)."""
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.strides[0]))).ravel(), return_inverse=True)[1].ravel()
    if same.max() + 1 == len(v):
        return np.arange(len(v))
    rows = pd.DataFrame({"key": keys, "same": same, "id": ids}).sort_values(["key", "same", "id"], kind="stable")
    rows = rows[rows.groupby(["key", "same", "id"]).cumcount() < k]
    new = (rows[["key", "same", "id"]] != rows[["key", "same", "id"]].shift()).any(axis=1)
    return np.sort(rows.index[new.groupby([rows["key"], rows["same"]]).cumsum() <= k + 1].to_numpy())


def best_of_blocks(queries: np.ndarray, qids: list, asked: dict[int, np.ndarray], k: int, exclude_self: bool, types: tuple):
    """Arrow function: (key, chunk_id, law, embedding) -> (qid, chunk_id, law, score), each task's k best for each query.

    ``asked`` has the rows of ``queries`` that ask for points of a key. Blocks of products choose
    pairs, with room for their rounding; those pairs get their cosine in the SQL's order of sums.
    """
    square = _sums(queries, queries)
    unit = queries / np.sqrt(square)[:, None]
    own: dict = {}
    for row, qid in enumerate(qids):
        own.setdefault(qid, []).append(row)

    def run(batches):
        near = np.full((len(queries), k), -np.inf)  # the k best of the products so far, the least first
        best = pd.DataFrame({"q": np.empty(0, np.int64), "score": np.empty(0), "id": np.empty(0, object), "law": np.empty(0, object)})
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_POINTS):
                rows = batch.slice(start, BLOCK_POINTS)
                keys, ids = rows.column("key").to_numpy(zero_copy_only=False), rows.column("chunk_id").to_numpy(zero_copy_only=False)
                v = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
                left = _least_ids(keys, v, ids, k)
                keys, ids, v = keys[left], ids[left], v[left]
                size = _sums(v, v)
                p = v / np.sqrt(size)[:, None]
                mine = [(col, own[x]) for col, x in enumerate(ids.tolist()) if x in own] if exclude_self else []
                found = []
                for key in np.unique(keys):
                    cols, members = np.flatnonzero(keys == key), asked.get(int(key), ())
                    for at in range(0, len(members), BLOCK_QUERIES):
                        q = members[at : at + BLOCK_QUERIES]
                        scores = unit[q] @ p[cols].T
                        for col, selves in mine:
                            if keys[col] == key:
                                scores[np.isin(q, selves), np.searchsorted(cols, col)] = -np.inf
                        more = np.flatnonzero(scores.max(axis=1) > near[q, 0])
                        if len(more):
                            near[q[more]] = np.sort(np.partition(np.concatenate([near[q[more]], scores[more]], axis=1), -k, axis=1)[:, -k:], axis=1)
                        a, b = np.nonzero((scores >= near[q, :1] - ROOM) & (scores > -np.inf))
                        found.append((q[a], cols[b], scores[a, b]))
                if not found:
                    continue
                a, b, s = (np.concatenate(x) for x in zip(*found))
                reach = s >= near[a, 0] - ROOM
                a, b = a[reach], b[reach]
                if not len(a):
                    continue
                exact = np.concatenate([_sums(queries[a[x : x + BLOCK_PAIRS]], v[b[x : x + BLOCK_PAIRS]]) for x in range(0, len(a), BLOCK_PAIRS)])
                laws = rows.column("law").take(pa.array(left[b])).to_pylist()
                met = pd.DataFrame({"q": a, "score": np.clip(exact / np.sqrt(square[a] * size[b]), -1, 1), "id": pd.Series(ids[b].tolist(), dtype=object), "law": pd.Series(laws, dtype=object)})
                best = pd.concat([best, met], ignore_index=True).sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
                best = best[best.groupby("q").cumcount() < k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([qids[q] for q in best["q"]], types[0]), pa.array(best["id"].tolist(), types[1]), pa.array(best["law"].tolist(), types[2]), pa.array(best["score"].to_numpy(np.float64), pa.float64())],
            names=["qid", "chunk_id", "law", "score"],
        )

    return run


def block_hits(points: DataFrame, queries: np.ndarray, qids: list, qid_type, asked: dict[int, np.ndarray], k: int, exclude_self: bool) -> DataFrame:
    """``best_of_blocks`` over ``points`` (key, chunk_id, law, embedding), all of them with a direction."""
    points = points.select("key", "chunk_id", "law", "embedding")
    out = StructType([StructField("qid", qid_type), points.schema["chunk_id"], points.schema["law"], StructField("score", DoubleType())])
    out = StructType([StructField(f.name, f.dataType) for f in out])
    return points.mapInArrow(best_of_blocks(queries, qids, asked, k, exclude_self, tuple(to_arrow_type(f.dataType) for f in out[:3])), out)


def _blocks(queries: DataFrame, points: DataFrame, dim: int, k: int, by_law: bool | None, exclude_self: bool) -> DataFrame:
    """``block_hits`` of queries and points that have a direction. The queries go through the driver: ``BROADCAST_QUERIES`` at most."""
    spark = queries.sparkSession
    rows = queries.select("qid", "law", F.transform("embedding", lambda x: x.cast("double")).alias("qv")).toArrow()
    vectors = rows.column("qv").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dim)
    qids, laws = rows.column("qid").to_pylist(), pd.Series(rows.column("law").to_pylist(), dtype=object)
    free = np.arange(len(qids)) if by_law is False else np.flatnonzero(laws.isna()) if by_law is None else np.empty(0, np.int64)
    asked, p = {0: free}, points.where(F.col("chunk_id").isNotNull() & has_direction(F.col("embedding"), dim)).select("chunk_id", "law", "embedding")
    if by_law is not False:
        named = {law: key for key, law in enumerate(laws.dropna().unique(), 1)}
        asked |= {key: np.sort(np.concatenate([free, np.flatnonzero(laws == law)])).astype(np.int64) for law, key in named.items()}
        known = spark.createDataFrame(list(named.items()), StructType([StructField("known", queries.schema["law"].dataType), StructField("named", IntegerType())]))
        p = p.join(F.broadcast(known), F.col("law") == F.col("known"), "inner" if by_law else "left").withColumn("key", F.coalesce("named", F.lit(0)))
    else:
        p = p.withColumn("key", F.lit(0))
    # a file may be a single task however many points it has
    p = p.repartition(spark.sparkContext.defaultParallelism, "chunk_id")
    return block_hits(p, vectors, qids, queries.schema["qid"].dataType, asked, k, exclude_self)


def _all_pairs(q: DataFrame, p: DataFrame, by_law: bool | None, exclude_self: bool) -> DataFrame:
    """(qid, chunk_id, law, score) of every pair."""
    q = q.select("qid", F.col("law").alias("q_law"), F.transform("embedding", lambda x: x.cast("double")).alias("qv")).withColumn("qn", norm(F.col("qv")))
    p = p.select("chunk_id", "law", F.transform("embedding", lambda x: x.cast("double")).alias("pv")).withColumn("pn", norm(F.col("pv")))
    same = F.col("q_law") == F.col("law")
    on = same if by_law else F.lit(True) if by_law is False else F.col("q_law").isNull() | same
    if exclude_self:
        on = on & (F.col("qid") != F.col("chunk_id"))
    return p.join(F.broadcast(q), on).select("qid", "chunk_id", "law", (dot(F.col("qv"), F.col("pv")) / (F.col("qn") * F.col("pn"))).alias("score"))


def dense_top_k(queries: DataFrame, points: DataFrame, k: int = 5, by_law: bool | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, dense_rank, chunk_id, law, score): the k points of highest cosine for each query.

    ``queries``: qid, law, embedding; ``points``: chunk_id, law, embedding. ``by_law`` true
    keeps the search within the query's law, false searches all, None searches all where the
    query's law is null. Ties go to the smaller chunk_id. Tasks score blocks of points against
    blocks of queries and keep k for each query; vectors that have no direction, like zero or
    null, are scored pair by pair.
    """
    kinds = [(IntegralType, StringType), (queries.schema["qid"].dataType, points.schema["chunk_id"].dataType)]
    plain = any(all(isinstance(t, kind) for t in kinds[1]) for kind in kinds[0])
    found = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = max(1, found.dim or 0)
    good = F.col("qid").isNotNull() & has_direction(F.col("embedding"), dim) if plain else F.lit(False)
    # more queries than can be broadcast are dealt to groups that can
    groups, hits = ceil(found.n / BROADCAST_QUERIES) or 1, None
    for g in range(groups):
        own = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g)
        odd_points = points.where(F.col("chunk_id").isNull() | ~has_direction(F.col("embedding"), dim)) if plain else points.limit(0)
        parts = [_all_pairs(own.where(~good), points, by_law, exclude_self), _all_pairs(own.where(good), odd_points, by_law, exclude_self)]
        if plain:
            parts.append(_blocks(own.where(good), points, dim, k, by_law, exclude_self))
        for part in parts:
            hits = part if hits is None else hits.unionByName(part)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k).select("qid", "dense_rank", "chunk_id", "law", "score")
