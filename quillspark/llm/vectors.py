"""Vectors of integers for exact searches: which rows count, blocks of rows in a task, exact products.

A search reads its query table, staged in the shared folder, in each task of the searched rows,
a batch at a time: the searched rows are never copied for the queries, and no task holds more
than ROWS rows and QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import split_uri, staged

#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Searched rows that a task holds at once, and queries that meet them at once.
ROWS, QUERIES = 32_768, 256
#: Rows of the sample that gives each query its first bound (those of the least hashed ids).
SAMPLE = 4096
#: Scaled components beyond it count as it; up to it, doubles are exact.
LARGEST = 2.0**53
_LONG = 2**63 - 1


def usable(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def sample(rows: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows, whatever the table's size; only they reach one task."""
    return staged(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size), "sample")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks, whatever their ids and vectors."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def gathered(batches: Iterator[pa.RecordBatch], size: int = ROWS) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows from a task's batches."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            held.append(part)
            n += part.num_rows
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def by_size(table: pa.Table, name: str = "embedding") -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """(dimension, its rows, their scaled integers as doubles) for each length of vector."""
    sizes = pc.list_value_length(table[name]).to_numpy()
    for dim in np.unique(sizes):
        own = table if (sizes == dim).all() else table.filter(pa.array(sizes == dim))
        flat = own[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST) + 0.0
        yield int(dim), own, scaled.reshape(own.num_rows, int(dim))


def stored(uri: str, size: int = QUERIES) -> Iterator[pa.Table]:
    """Batches of a staged table, read in a task."""
    store, path = split_uri(uri)
    return gathered(pads.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=size), size)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows (q: a x d, x: b x d): long, held at its ends."""
    if q.shape[1] * (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    big = q.astype(np.int64).astype(object) @ x.T.astype(np.int64).astype(object)
    return np.clip(big, -_LONG, _LONG).astype(np.int64)


def pair_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``products`` of rows in the same place."""
    if q.shape[1] * (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    big = (q.astype(np.int64).astype(object) * x.astype(np.int64).astype(object)).sum(axis=1)
    return np.clip(big, -_LONG, _LONG).astype(np.int64)
