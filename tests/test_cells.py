"""Dense search over stored cells against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cells as C
from quillspark.operators import dense as D

SCHEMA = "chunk_id long, law string, embedding array<float>"


def clustered(spark, n=3000, groups=30, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, dim))
    v = middle[rng.integers(0, groups, n)] + 0.25 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(k, f"law{k % 4}", (v[k] * (1 + k % 3)).tolist()) for k in range(n)], SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    points = clustered(spark).cache()
    return points, C.build(spark, str(tmp_path_factory.mktemp("cells") / "i"), points, 32)


def queries_of(points):
    return points.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qid")


def rows_of(hits):
    return sorted((r.qid, r.dense_rank, r.chunk_id, r.law, round(r.score, 9)) for r in hits.collect())


@pytest.mark.parametrize("by_law", [False, True, None])
def test_certified_rows_are_exact(spark, stored, by_law):
    points, index = stored
    q = queries_of(points)
    found = C.search(spark, index, q, 5, by_law, probes=2, certified=True, exclude_self=True)
    assert rows_of(found.hits) == rows_of(D.dense_top_k(q, points, 5, by_law, exclude_self=True))
    assert C.share_read(spark, index, found, q) < 0.5


def test_recall_and_share_of_points(spark, stored):
    points, index = stored
    q = queries_of(points)
    exact = D.dense_top_k(q, points, 5, False)
    found = C.search(spark, index, q, 5, False, probes=12)
    assert C.recall(found.hits, exact) >= 0.95 and C.share_read(spark, index, found, q) < 0.15
    every = C.search(spark, index, q, 5, False, probes=10_000)
    assert C.recall(every.hits, exact) == 1.0 and C.share_read(spark, index, every, q) == pytest.approx(1.0)


def test_only_asked_folders_are_read(spark, stored):
    points, index = stored
    one = queries_of(points).where("qid = 50")
    found = C.search(spark, index, one, 5, True, probes=3)
    assert "dynamicpruning" in found.hits._jdf.queryExecution().executedPlan().toString()
    files = index.points(spark).select("law", "cell", F.col("_metadata.file_path").alias("f"))
    folders = files.join(F.broadcast(found.probed.where("n > 0").select("law", "cell")), ["law", "cell"]).select("law", "f").distinct().collect()
    assert {r.law for r in folders} == {"law2"} and len(folders) < 20


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", None), (4, "b", [nan, 1.0]), (5, None, [0.0, 1.0]), (6, "a", [1.0, 0.0]), (7, "b", [-1.0, 0.5]), (8, "b", [None, 1.0])]
    points = spark.createDataFrame(rows, SCHEMA)
    index = C.build(spark, str(tmp_path / "i"), points, 8)
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [0.0, 2.0]), (3, "a", [0.0, 0.0]), (4, "z", [1.0, 1.0])], "qid long, law string, embedding array<float>")
    good = points.where("chunk_id IN (1, 5, 6, 7)")
    asking = q.where("qid <> 3")
    for by_law in (False, True, None):
        found = C.search(spark, index, q, 3, by_law, probes=1, certified=True)
        assert rows_of(found.hits) == rows_of(D.dense_top_k(asking, good, 3, by_law))
    with pytest.raises(ValueError, match="no points"):
        C.build(spark, str(tmp_path / "none"), points.limit(0))
