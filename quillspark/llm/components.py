"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


#: Parts that the neighbours of a node are dealt to, so that no task gets all of a hub's.
PARTS = 8


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours. Partial sums come first."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("p"))
    return pairs.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(least, ["u", "p"]).drop("p")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least_neighbour(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return down.select(
        F.explode(F.array(F.struct(F.col("u").alias("b"), F.col("m").alias("a")), F.struct(F.col("v").alias("b"), F.col("m").alias("a")))).alias("e")
    ).select("e.*").where("a < b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node long, root long) for every node of an edge.

    ``root`` is the least node that can be reached; it has no row of its own. Null ends,
    loops and repeated edges are ignored; an empty table gives an empty one. Each round is
    written to the shared folder, so lineage stays short and lost executors cost one round; the
    round before it is deleted then.
    Rounds grow with the logarithm of the largest component.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = staged(now, "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark or seen.n == 0:
            break
        mark = (seen.n, seen.h)
        last, now = now, staged(_small_star(_large_star(now)).distinct(), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # an empty table too: createDataFrame would start Python workers of their own in each executor, and these stay
    return now.select(F.col("b").cast("long").alias("node"), F.col("a").cast("long").alias("root"))


class Forest:
    """Union-find whose successful unions are the edges of a spanning forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self, idx: np.ndarray) -> np.ndarray:
        at = self.up[idx]
        while True:
            nxt = self.up[at]
            if np.array_equal(nxt, at):
                self.up[idx] = at
                return at
            at = nxt

    def star(self, hub: int, idx: np.ndarray) -> None:
        """Link ``hub`` with all of ``idx``."""
        rs, first = np.unique(self.roots(idx), return_index=True)
        own = self.root(hub)
        for r, k in zip(rs.tolist(), first.tolist()):
            if r != own:
                self.up[r] = own
                self.edges.append((hub, int(idx[k])))
