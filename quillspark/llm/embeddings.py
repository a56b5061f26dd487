"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on random Gaussian directions. On each, a vector's window is the
values within ``width`` of its own; a pair's collisions are the projections on which one lies
in the other's window. For a pair at the threshold a projection collides with a known
probability, so the count that all but MISS of such pairs reach follows from the binomial
distribution. Pairs that reach it are verified by cosine in double precision.

Equal vectors are one class with a number of members. A label's classes are dealt into blocks;
a task takes two blocks and sorts them on the first projection. A stretch of one block meets only
the other's values within a wide window on it, which all but MISS of the links keep; on the
projections that follow a pair is dropped as soon as its collisions can't reach the count any
more. A task gives each class's number of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .shared import staged

THRESHOLD = 0.98
PROJECTIONS = 24
#: Half a window in standard deviations of a threshold pair's distance on one projection.
WIDTH_SD = 3.0
#: Share of threshold pairs that may fall short of the count.
MISS = 1e-7
#: Vectors in a block; a task meets two blocks at a time.
BLOCK = 2048
#: Vectors of a block that are searched for at once, and projections counted on all of their pairs at once.
STRETCH, FIRST_PROJECTIONS = 64, 6


def calibrate(threshold: float = THRESHOLD, projections: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int]:
    """(half-width of a window, collisions needed) for a recall of 1 - miss at the threshold."""
    width = WIDTH_SD * sqrt(2 - 2 * threshold)
    p = erf(WIDTH_SD / sqrt(2))
    below, need = 0.0, 0
    while need <= projections:
        below += comb(projections, need) * p**need * (1 - p) ** (projections - need)
        if below > miss:
            break
        need += 1
    return width, need


def wide_window(threshold: float = THRESHOLD, miss: float = MISS) -> float:
    """Half a window on one projection that all but ``miss`` of the pairs at the threshold share."""
    sd = 0.0
    while 1 - erf(sd / sqrt(2)) > miss:
        sd += 0.01
    return sd * sqrt(2 - 2 * threshold)


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, projections))


def _usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _plain(v: Column) -> Column:
    """In double precision, zeros without sign."""
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, members) of distinct usable vectors with a label; rep is the least vec_id."""
    good = vectors.where(F.col("label").isNotNull() & _usable(F.col("embedding")))
    return good.groupBy("label", _plain(F.col("embedding")).alias("embedding")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))


def _pair_blocks(reps: DataFrame, block: int) -> DataFrame:
    """Classes dealt to pairs of blocks (lo, hi) of their label and size: each block meets each other once.

    Blocks are dealt by hash, so every one holds about ``block`` classes at most, whatever the
    label's share of the rows.
    """
    keyed = reps.withColumn("dim", F.size("embedding"))
    sizes = keyed.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    keyed = keyed.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return keyed.select("label", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "members", F.transform("embedding", lambda x: x.cast("float")).alias("v"))


def candidates(px: np.ndarray, py: np.ndarray, width: float, need: int, wide: float):
    """Pairs of rows of two sets of projections (vectors x projections) that collide ``need`` times, in batches (rows, columns).

    Both are sorted on the first projection already.
    """
    projections = px.shape[1]
    for at in range(0, len(px), STRETCH):
        x = px[at : at + STRETCH]
        lo, hi = np.searchsorted(py[:, 0], x[0, 0] - wide, "left"), np.searchsorted(py[:, 0], x[-1, 0] + wide, "right")
        if lo == hi:
            continue
        y = py[lo:hi]
        # collisions missed so far; a pair may miss projections - need
        missed = np.zeros((len(x), len(y)), np.int8)
        for k in range(min(FIRST_PROJECTIONS, projections)):
            missed += np.abs(x[:, k, None] - y[None, :, k]) > width
        rows, cols = np.nonzero(missed <= projections - need)
        missed = missed[rows, cols]
        for k in range(FIRST_PROJECTIONS, projections):
            missed += np.abs(x[rows, k] - y[cols, k]) > width
            alive = missed <= projections - need
            rows, cols, missed = rows[alive], cols[alive], missed[alive]
        if len(rows):
            yield at + rows, lo + cols


def _links(threshold: float, projections: int, width: float, need: int):
    """Group function: rows (a, b, n): a's links with other classes' members, or b set for an edge of the forest."""
    wide = wide_window(threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        p = (v @ directions(v.shape[1], projections)).astype(np.float32)
        order = np.lexsort((pdf["rep"].to_numpy(), p[:, 0]))
        own, ids, members, v, p = pdf["own"].to_numpy()[order], pdf["rep"].to_numpy()[order], pdf["members"].to_numpy()[order], v[order], p[order]
        left, right = np.nonzero(own == lo)[0], np.nonzero(own == hi)[0]
        total, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        # projections in single precision: the windows are wider by its error
        for rows, cols in candidates(p[left], p[right], width + 1e-4, need, wide + 1e-4):
            rows, cols = left[rows], right[cols]
            if lo == hi:
                rows, cols = rows[rows < cols], cols[rows < cols]
            sure = np.concatenate([np.einsum("ij,ij->i", v[rows[k : k + 65536]], v[cols[k : k + 65536]]) >= threshold for k in range(0, len(rows), 65536)] or [np.empty(0, bool)])
            rows, cols = rows[sure], cols[sure]
            np.add.at(total, rows, members[cols])
            np.add.at(total, cols, members[rows])
            heads = np.nonzero(np.append(True, rows[1:] != rows[:-1]))[0] if len(rows) else []
            for s, e in zip(heads, [*heads[1:], len(rows)]):
                forest.star(int(rows[s]), cols[s:e])
        some = np.nonzero(total)[0]
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[edges[:, 0]]]), "b": pd.array([None] * len(some) + ids[edges[:, 1]].tolist(), "Int64"), "n": np.concatenate([total[some], np.zeros(len(edges), np.int64)])})

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows with a null label, or a vector that is null, empty or zero or holds null or
    non-finite components, link with nothing. Vectors of different sizes don't link. Repeated
    rows are vectors of their own; a null vec_id may link but gives no component its id. An
    empty table gives an empty one; other columns aren't used.
    """
    width, need = calibrate(threshold, projections)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    reps = staged(classes(rows), "vector-classes")
    dealt = _pair_blocks(reps.where("rep is not null"), block)
    found = staged(dealt.groupBy("label", "dim", "lo", "hi").applyInPandas(_links(threshold, projections, width, need), "a long, b long, n long"), "vector-links")
    roots = connected_components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    known = reps.join(linked, "rep", "left").join(roots, reps.rep == roots.node, "left")
    known = known.select("label", F.col("embedding").alias("plain"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    # rows that link with nothing have no class: they don't go through the join
    usable = F.coalesce(F.col("label").isNotNull() & _usable(F.col("embedding")), F.lit(False))
    mine = rows.where(usable).select("vec_id", "label", _plain(F.col("embedding")).alias("plain"))
    out = mine.join(known, ["label", "plain"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
