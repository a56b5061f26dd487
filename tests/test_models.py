"""Models in workers: one load a worker, batches of like length, scores and times by row."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answer as A
from quillspark.operators import models as M


@pytest.fixture
def shipped(spark, tmp_path):
    folder = str(tmp_path / "model")
    return M.ship(spark, folder, f"m{abs(hash(folder))}.json", json.dumps({"words": 0.75, "pairs": 0.25}).encode())


def pairs(spark, n=500):
    rows = [(k // 10, f"q{k % 7} word {k % 3}", ("word " + f"q{k % 5} ") * (k % 23) if k % 11 else None, k % 10 + 1, k) for k in range(n)]
    return spark.createDataFrame(rows, "qid int, query string, passage string, rank int, chunk_id int")


def test_ranks_of_the_row_by_row_version(spark, shipped):
    rows = pairs(spark).repartition(4)
    got = A.rerank(rows, 5, M.scorer(shipped, M.OverlapModel.load))
    model, want = M.OverlapModel(0.75, 0.25), {}
    for r in rows.collect():
        want.setdefault(r.qid, []).append((-model.predict([(r.query, r.passage or "")])[0], r["rank"], r.chunk_id))
    best = sorted((q, n + 1, c, round(-s, 9)) for q, rs in want.items() for n, (s, _, c) in enumerate(sorted(rs)[:5]))
    assert sorted((r.qid, r.rerank_rank, r.chunk_id, round(r.rerank_score, 9)) for r in got.collect()) == best


def test_batches_hold_texts_of_like_length():
    seen = []

    def predict(batch):
        seen.append([len(p) for _, p in batch])
        return [len(p) * 10 for _, p in batch]

    texts = [("q", "x" * (k * 37 % 101)) for k in range(101)]
    scores, seconds = M.predict_by_length(predict, texts, 8)
    assert scores == [len(p) * 10 for _, p in texts] and all(s > 0 for s in seconds)
    assert [len(b) for b in seen] == [8] * 12 + [5] and [x for b in seen for x in b] == sorted(len(p) for _, p in texts)
    with pytest.raises(ValueError, match="1 scores for 2 pairs"):
        M.predict_by_length(lambda b: [1.0], [("a", "b"), ("c", "d")])


def test_a_worker_loads_once(spark, shipped, tmp_path):
    """Many batches and partitions: as many loads as workers."""
    log, load = str(tmp_path / "loads"), M.OverlapModel.load

    def counted(path):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return load(path)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        score = M.scorer(shipped, counted)
        for _ in range(2):
            assert pairs(spark, 1000).repartition(16).select(F.sum(score(F.col("query"), F.col("passage")))).first()[0] > 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    loads = open(log).read().split()
    assert 1 <= len(loads) == len(set(loads)) <= 8


def test_times_of_each_question(spark, shipped):
    questions = spark.createDataFrame([(k, "a", f"word {k}", [1.0, float(k)]) for k in range(6)], "qid int, law string, query string, embedding array<float>")
    points = spark.createDataFrame([(k, "a", [1.0, k / 3]) for k in range(40)], "chunk_id int, law string, embedding array<float>")
    chunks = points.select("chunk_id", F.lit("제1조").alias("article"), F.lit("t").alias("article_title"), F.expr("repeat('word ', chunk_id + 1)").alias("text"))

    def answer(prompt):
        time.sleep(0.01)
        return A.answer_of(prompt)

    began = time.time()
    rows = A.timed_rag(questions, points, chunks, use_reranker=True, candidates=10, scorer=M.timed_scorer(shipped, M.OverlapModel.load), answer=answer).collect()
    wall = time.time() - began
    assert len(rows) == 6 and all(r.llm_sec >= 0.01 and r.retrieval_sec > 0 for r in rows)
    assert len({r.llm_sec for r in rows}) > 1 and len({r.retrieval_sec for r in rows}) > 1
    assert sum(r.llm_sec for r in rows) + sum(r.retrieval_sec for r in rows) < 4 * wall
    plain = {r.qid: r for r in A.run_rag(questions, points, chunks, use_reranker=True, candidates=10, scorer=M.scorer(shipped, M.OverlapModel.load)).collect()}
    assert all((r.answer, r.context, r.docs) == (plain[r.qid].answer, plain[r.qid].context, plain[r.qid].docs) for r in rows)
    dense = A.timed_rag(questions, points, chunks).collect()
    assert len(dense) == 6 and len({r.retrieval_sec for r in dense}) == 1
