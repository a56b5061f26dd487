"""op11 to op13 against brute force on small tables, with odd rows added."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives, topk, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, floor long, i int, x string"


def odd_rows(seed=0, n=400, dim=6):
    """Repeated vectors, ties, nulls, other lengths; a third of the rows are one vector."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) / 2
    v[rng.random(n) < 0.33] = v[0]
    rows = [(k, v[k].tolist(), int(k % 3), None, None, None, None, "s") for k in range(n)]
    nan, inf = float("nan"), float("inf")
    more = [(1000, None, 0), (1001, [], 0), (1050, [], 1), (1002, [None] * dim, 0), (1003, [nan] * dim, 1), (1004, [inf] + [0.0] * (dim - 1), 1), (1100, [0.0] * dim, 2), (None, v[1].tolist(), 1), (1200, v[2].tolist(), None), (1300, [1.0, -2.0, 3.0], 1), (1301, [1.0, 2.0, 3.0], 2), (1302, [1.0, 2.0, 3.5], 1), (-100, [-0.0] * dim, 2), (1400, [3e38] * dim, 0), (7, v[7].tolist(), 1), (300, v[0].tolist(), 0)]
    return rows + [(a, b, c, 1, 1, 1, 1, "t") for a, b, c in more]


def usable(rows, labelled=False):
    return [(r[0], [int(np.clip(np.floor(np.float64(np.float32(c)) * 256), -(2**53), 2**53)) for c in r[1]], r[2]) for r in rows if r[0] is not None and r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1]) and (r[2] is not None or not labelled)]


def dot(a, b):
    return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def askers(rows, by, key):
    """The least row of each id that is divisible."""
    own = {}
    for r in rows:
        if r[0] % by == 0:
            own[r[0]] = min(own.get(r[0], r), r, key=key)
    return own.values()


def top_k(rows, by, k):
    out = []
    for q in askers(rows, by, lambda r: r[1]):
        met = sorted((-dot(q[1], r[1]), r[0]) for r in rows if r[0] != q[0] and len(r[1]) == len(q[1]))
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(met[:k])]
    return sorted(out)


def mined(rows, by, positives=5, count=10, low=30, high=90):
    out = []
    for a in askers(rows, by, lambda r: (r[2], r[1])):
        met = sorted((-dot(a[1], r[1]), r[0], r[2]) for r in rows if r[0] != a[0] and len(r[1]) == len(a[1]))
        for s, p, _ in [m for m in met if m[2] == a[2]][:positives]:
            inside = [m for m in met if m[2] != a[2] and low * -s <= 100 * -m[0] <= high * -s][:count]
            out += [(a[0], p, n + 1, m[1], -s, -m[0]) for n, m in enumerate(inside)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # many blocks, tiles and steps
        monkeypatch.setattr(topk, "TILE", 7)
    rows = odd_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, 60 if small else None)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows_of(got) == top_k(usable(rows), 50, 5)


def test_top_k_of_double_vectors(spark):
    rows = [(k, [k / 7 + 1e-9, -k / 3], None) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = top_k([(k, [int(np.floor(256 * c)) for c in v], None) for k, v, _ in rows], 5, 3)
    assert rows_of(topk.top_k(df, df.where("vec_id % 5 = 0"), 3)) == want


def test_segments_drop_structured_rows():
    """Smooth vectors: means of few segments tell most pairs apart; scores stay exact."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.cumsum(rng.standard_normal((4000, 64)), axis=1) / 40)
    ids = np.arange(len(x))
    near = topk.Searched(ids, x)
    q, own = x[::100], ids[::100]
    rows, found, scores = near.best(own, q, np.full(len(q), topk.LEAST), 5)
    kth = scores[4::5]
    near.tested = [0] * len(near.tested)
    again = near.best(own, q, kth, 5)
    assert [a.tolist() for a in again] == [rows.tolist(), found.tolist(), scores.tolist()]
    assert near.tested[0] == len(x) * len(q) and near.tested[-1] < 0.05 * near.tested[0]
    exact = (q @ x.T).astype(int)
    exact[np.arange(len(q)), own] = topk.LEAST
    assert scores.tolist() == np.sort(exact, axis=1)[:, :-6:-1].ravel().tolist()


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 17, 64])
def test_bounds_hold_and_fall(dim):
    rng = np.random.default_rng(dim)
    a, b = np.floor(300 * rng.standard_normal((50, dim))), np.floor(300 * rng.standard_normal((60, dim)))
    bound = np.full((50, 60), np.inf)
    for s in topk.segment_counts(dim):
        finer = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (finer <= bound + 1e-6 * np.abs(finer)).all()
        bound = finer
    assert (bound >= a @ b.T - 1e-6 * np.abs(a @ b.T) - 1e-6).all()


@pytest.mark.parametrize("codewords,train", [(4, 8192), (3, 20), (32, 8192)])
def test_hard_negatives(spark, monkeypatch, codewords, train):
    monkeypatch.setattr(negatives, "FIRST_ROWS", 8)
    rows = odd_rows(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, df.where("vec_id % 50 = 0"), codewords=codewords, train_rows=train)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == mined(usable(rows, True), 50)


def test_walk_visits_cells_by_bound_and_stops():
    """Clustered rows: an anchor's walk scores few of them."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + 0.05 * rng.standard_normal((6000, 16))))
    books = negatives.codebooks(x[:2000], 16)
    stretch = negatives.Stretch(np.arange(6000), np.zeros(6000, int), x, (negatives.nearest(x[:, :8], books[0]), negatives.nearest(x[:, 8:], books[1])), books)
    for a in range(0, 6000, 500):
        best, seen = negatives.Best(5), 0
        for rows, scores in stretch.walk(x[a], lambda: best.low):
            best.add(scores, rows)
            seen += len(rows)
        exact = (x @ x[a]).astype(int)
        assert best.scores.tolist() == np.sort(exact)[:-6:-1].tolist()
        assert seen < 3000


def test_window_of_scores():
    assert negatives.window(100, 30, 90) == (30, 90) and negatives.window(101, 30, 90) == (31, 90)
    assert negatives.window(0, 30, 90) == (0, 0)
    low, high = negatives.window(-100, 30, 90)
    assert low > high


def whitened(rows, k=4):
    x = [(r[0], r[1]) for r in rows]
    u = np.array(sorted({tuple(v) for _, v in x}), float)
    n, s = len(u), [sum(int(v) for v in col) for col in zip(*u.astype(int).tolist())]
    c = u - u.mean(axis=0)
    e, w = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], w[:, ::-1], u.mean(axis=0)


@pytest.mark.parametrize("small", [False, True])
def test_whitening(spark, monkeypatch, small):
    if small:  # many blocks and splits
        monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
        monkeypatch.setattr(whitening, "TASK_BLOCKS", 3)
    rows = [r for r in odd_rows(4) if r[1] is None or max((abs(c) for c in r[1] if c is not None), default=0) < 1e30 or not np.isfinite(sum(r[1]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    good = [(r[0], [int(np.floor(np.float64(np.float32(c)) * 256)) for c in r[1]]) for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and np.isfinite(c) for c in r[1])]
    n, s, e, w, mean = whitened(good)
    want = {}
    for i, v in good:
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
        for c in range(4):
            want.setdefault(c + 1, []).append((i, deviation, (np.array(v) - mean) @ w[:, c] / np.sqrt(e[c])))
    have = got.collect()
    assert len(have) == 4 * len(good) and {r.n for r in have} == {n} and max(r.identity_error for r in have) < 1e-9
    for c in range(1, 5):
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        mine = sorted(((r.vec_id, r.deviation, r.whitened) for r in have if r.component == c), key=key)
        theirs = sorted(want[c], key=key)
        assert [r[:2] for r in mine] == [r[:2] for r in theirs]
        a, b = np.array([r[2] for r in mine]), np.array([r[2] for r in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert max(abs(r.explained - e[c - 1] / e.sum()) for r in have if r.component == c) < 1e-12


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert rows_of(whitening.whiten(one)) == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened) if r.whitened is not None else None, r.explained) for r in got) == [(1, 1, 2, 65536, 1.0, 1.0), (1, 2, 2, 65536, None, 0.0), (2, 1, 2, 65536, 1.0, 1.0), (2, 2, 2, 65536, None, 0.0)]
    huge = spark.createDataFrame([(1, [3e15]), (2, [-3e15])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_empty_vectors_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for rows in (none, spark.createDataFrame([(1, None, 1, None, None, None, None, None)], SCHEMA)):
        assert topk.top_k(rows, rows, 5).count() == 0
        assert negatives.hard_negatives(rows, rows).count() == 0
        assert whitening.whiten(rows).count() == 0
    some = spark.createDataFrame(odd_rows(), SCHEMA)
    assert topk.top_k(some, none, 5).count() == topk.top_k(none, some, 5).count() == 0
    assert negatives.hard_negatives(some, none).count() == 0


def test_exact_products_beyond_doubles():
    big = np.array([[2.0**53, 1.0], [2.0**30, 3.0]])
    assert vectors.products(big, big).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**60 + 9]]
    assert vectors.pair_products(big[1:], big[1:]).tolist() == [2**60 + 9]


def test_numbering_is_dense(spark):
    df = whitening.numbered(spark.range(1000).repartition(7).select(F.col("id").alias("n")))
    assert sorted(r["index"] for r in df.collect()) == list(range(1000))
