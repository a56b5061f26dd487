"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments, and a segment of length L into its mean m and deviation s. For
two vectors the squared distance is at least the sum of L ((m - m')^2 + (s - s')^2), so their
inner product is at most the sum of L (m m' + s s'). The bound is taken over 1, 4, 16, ...
segments: from coarse to fine it only falls, and pairs whose bound is below the query's k-th
best score are dropped at each step. Survivors get exact integer scores.

A query's first k-th best score comes from a bounded sample of the rows; it is a score of real
rows, so nothing that belongs to the result is dropped. Each task searches its own rows for all
queries, read from the shared folder in batches, and gives at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, staged
from .vectors import by_size, dealt, gathered, pair_products, products, sample, stored, usable

#: Rows that a batch of queries meets at once.
TILE = 4096
#: Share of the pairs of a tile below which those left are listed one by one.
FEW = 1 / 16
#: No score is below it.
LEAST = -(2**63)


def segment_counts(dim: int) -> list[int]:
    """1, 4, 16, ... segments: fewer than half the components, since finer ones cost what exact scores do."""
    out = [1]
    while out[-1] * 8 < dim:
        out.append(out[-1] * 4)
    return out if dim > 1 else []


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments times the root of their length, so that an inner product of two rows is the bound."""
    starts = np.arange(segments) * x.shape[1] // segments
    lengths = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / lengths
    rest = x - np.repeat(mean, lengths, axis=1)
    return np.hstack([mean * np.sqrt(lengths), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))])


class Searched:
    """Rows with their statistics, from coarse to fine. ``tested`` counts the pairs that each step was left with."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.levels = [statistics(x, s) for s in segment_counts(x.shape[1])]
        self.tested = [0] * (len(self.levels) + 1)

    def survivors(self, q: np.ndarray, q_levels: list[np.ndarray], floors: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, rows of the tile at ``at``, exact scores) of all pairs that may reach their query's floor."""
        x, end = self.x[at : at + TILE], at + TILE
        # scores are integers: half of one, and what rounding of the bounds may take away
        room = 0.5 + 1e-9 * np.linalg.norm(q, axis=1) * np.sqrt((x * x).sum(axis=1).max(initial=0))
        least = floors.astype(np.float64) - room - 1e-12 * np.abs(floors.astype(np.float64))
        mask, rows, cols = np.ones((len(q), len(x)), bool), None, None
        for n, (ql, xl) in enumerate(zip(q_levels, self.levels)):
            if rows is None:
                self.tested[n] += int(mask.sum())
                mask &= ql @ xl[at:end].T >= least[:, None]
                if mask.mean() < FEW:
                    rows, cols = np.nonzero(mask)
            else:
                self.tested[n] += len(rows)
                sure = np.einsum("ij,ij->i", ql[rows], xl[at:end][cols]) >= least[rows]
                rows, cols = rows[sure], cols[sure]
        if rows is None:
            self.tested[-1] += int(mask.sum())
            scores = products(q, x)
            rows, cols = np.nonzero(mask & (scores >= floors[:, None]))
            return rows, at + cols, scores[rows, cols]
        self.tested[-1] += len(rows)
        scores = pair_products(q[rows], x[cols])
        sure = scores >= floors[rows]
        return rows[sure], at + cols[sure], scores[sure]

    def best(self, q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, ids, scores): each query's ``k`` best rows of another id that reach its floor, ties to the smaller id."""
        floors, levels = floors.copy(), [statistics(q, s) for s in segment_counts(q.shape[1])]
        rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(self.x), TILE):
            r, c, s = self.survivors(q, levels, floors, at)
            other = self.ids[c] != q_ids[r]
            rows, ids, scores = np.concatenate([rows, r[other]]), np.concatenate([ids, self.ids[c[other]]]), np.concatenate([scores, s[other]])
            # ~s falls as s rises, at the least long too
            order = np.lexsort((ids, ~scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full = place == k - 1
            floors[rows[full]] = np.maximum(floors[rows[full]], scores[full])
            rows, ids, scores = rows[place < k], ids[place < k], scores[place < k]
        return rows, ids, scores


def _batches(uri: str, dim: int):
    """(ids, vectors, floors) of the queries of a dimension."""
    for table in stored(uri):
        for own, part, q in by_size(table):
            if own == dim:
                yield part["vec_id"].to_numpy(), q, part["floor"].fill_null(LEAST).to_numpy()


def _with_floors(queries: DataFrame, sample_uri: str, k: int) -> DataFrame:
    """``queries`` with the k-th best score among the sample; null where it has fewer rows."""

    def run(batches):
        for table in gathered(batches, 1024):
            for dim, part, q in by_size(table):
                floors, ids = np.full(len(q), LEAST), part["vec_id"].to_numpy()
                found = {}
                for rows in stored(sample_uri, TILE):
                    for own, near, x in by_size(rows):
                        if own == dim:
                            for r, s in zip(*Searched(near["vec_id"].to_numpy(), x).best(ids, q, floors, k)[::2]):
                                found.setdefault(int(r), []).append(int(s))
                kth = [sorted(found[r])[-k] if len(found.get(r, ())) >= k else None for r in range(len(q))]
                out = part.select(["vec_id", "embedding"]).append_column("floor", pa.array(kth, pa.int64()))
                yield from out.to_batches()

    schema = f"vec_id long, embedding {queries.schema['embedding'].dataType.simpleString()}, floor long"
    return queries.select("vec_id", "embedding").mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of highest score, ties to the smaller vec_id.

    Both tables: vec_id, embedding; each component counts as floor(256 x) in double precision,
    the score is the integer inner product. Rows without vec_id, and vectors that are null or
    hold null or non-finite components, take no part; vectors meet those of their own length
    only, so an empty one meets empty ones with score 0. A query doesn't meet rows of its own
    vec_id; of query rows that share one the least vector asks; repeated rows are found each.
    Components beyond 2^53 count as that, scores beyond long as its end. An empty table gives
    an empty one; other columns aren't used.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asking = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asking = asking.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = sample(rows) if sample_rows is None else sample(rows, sample_rows)
    asked = staged(_with_floors(asking, first.staged_path, k), "queries")
    discard(first)
    uri = asked.staged_path

    def run(batches):
        for table in gathered(batches):
            for dim, part, x in by_size(table):
                near = Searched(part["vec_id"].to_numpy(), x)
                for q_ids, q, floors in _batches(uri, dim):
                    r, ids, scores = near.best(q_ids, q, floors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = dealt(rows).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = staged(ranked.select("query_id", "rank", "vec_id", "score"), "top-k")
    discard(asked)
    return out
