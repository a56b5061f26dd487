"""Hard negatives from an inverted multi-index, by windows of a positive's score.

Each half of the vectors has a codebook; a row's two nearest codewords are its cell. All rows
are stored by cell in the shared folder: files hold ranges of cells, and a cell with many rows is
cut by hashed id, so a vector that a third of the rows share fills several files.

A half of a row in codeword c's cell scores at most q.c + |q| r with a half of an anchor, r
being the largest distance of such a half from c, and at least q.c - |q| r. In each stretch of
the index a heap walks the grid of both halves' codewords, ordered by bound, in the order of the
summed bounds (the multi-sequence algorithm). Rows of visited cells get exact scores; the walk
ends when no cell left can reach a place: first for an anchor's best rows of its own label (the
positives), then for every window of negative scores that a positive opens. Cells that lie above
all windows are passed over. Results of the stretches are merged by rank.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, staged
from .vectors import by_size, gathered, products, sample, stored, usable

#: Codewords of each half: their square is the number of cells.
CODEWORDS = 32
#: Rows that codebooks are trained on, and rounds of k-means.
TRAIN_ROWS, ROUNDS = 8192, 8
#: Rows scored at once at first; each further step of a walk takes twice as many.
FIRST_ROWS = 256
LEAST = -(2**63)


def codebooks(x: np.ndarray, codewords: int = CODEWORDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the first and of the second half of ``x`` by k-means."""
    cut = x.shape[1] // 2

    def trained(half: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(11)
        distinct = np.unique(half, axis=0)
        words = distinct[np.sort(rng.permutation(len(distinct))[:codewords])]
        for _ in range(rounds):
            own = nearest(half, words)
            sums = np.zeros_like(words)
            np.add.at(sums, own, half)
            n = np.bincount(own, minlength=len(words))
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        return words

    return trained(x[:, :cut]), trained(x[:, cut:])


def nearest(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * (half @ words.T), axis=1)


class Stretch:
    """Rows of the index in the order of their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, cells: tuple[np.ndarray, np.ndarray], books: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort(cells[::-1])
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        i, j = cells[0][order], cells[1][order]
        self.cut, self.halves, at = x.shape[1] // 2, [], []
        for own, words, half in ((i, books[0], self.x[:, : self.cut]), (j, books[1], self.x[:, self.cut :])):
            there, place = np.unique(own, return_inverse=True)
            radius = np.zeros(len(there))
            np.maximum.at(radius, place, np.linalg.norm(half - words[own], axis=1))
            self.halves.append((words[there], radius))
            at.append(place)
        key = at[0] * len(self.halves[1][0]) + at[1]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(key))
        self.cells = {(int(at[0][s]), int(at[1][s])): (int(s), int(e)) for s, e in zip(starts, ends)}
        self.longest = float(np.linalg.norm(self.x, axis=1).max(initial=0))

    def walk(self, q: np.ndarray, needed, above: float = np.inf):
        """Yield (row numbers, exact scores) of cells in falling order of their bounds, until none left reaches ``needed()``.

        Cells whose rows all score more than ``above`` are passed over.
        """
        room = 0.5 + 1e-9 * np.linalg.norm(q) * self.longest  # of rounding
        upper, lower, orders = [], [], []
        for half, (words, radius) in zip((q[: self.cut], q[self.cut :]), self.halves):
            mid, spread = words @ half, np.linalg.norm(half) * radius
            order = np.argsort(-(mid + spread), kind="stable")
            upper.append((mid + spread)[order].tolist())
            lower.append((mid - spread)[order].tolist())
            orders.append(order.tolist())
        heap, pushed, held, n, most = ([(-(upper[0][0] + upper[1][0]), 0, 0)] if self.cells else []), {(0, 0)}, [], 0, FIRST_ROWS
        while heap:
            bound, a, b = heapq.heappop(heap)
            if -bound + room < needed():
                break
            for nxt in ((a + 1, b), (a, b + 1)):
                if nxt not in pushed and nxt[0] < len(upper[0]) and nxt[1] < len(upper[1]):
                    pushed.add(nxt)
                    heapq.heappush(heap, (-(upper[0][nxt[0]] + upper[1][nxt[1]]), *nxt))
            cell = self.cells.get((orders[0][a], orders[1][b]))
            if cell and lower[0][a] + lower[1][b] - room <= above:
                held.append(cell)
                n += cell[1] - cell[0]
            if n >= most or (held and not heap):
                rows = np.concatenate([np.arange(s, e) for s, e in held])
                yield rows, products(q[None, :], self.x[rows])[0]
                held, n, most = [], 0, 2 * most
        if held:
            rows = np.concatenate([np.arange(s, e) for s, e in held])
            yield rows, products(q[None, :], self.x[rows])[0]


class Best:
    """The ``k`` best (score, id) between ``low`` and ``high``, ties to the smaller id."""

    def __init__(self, k: int, low: int = LEAST, high: int = 2**63 - 1):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.low) & (scores <= self.high)
        if fits.any():
            scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
            order = np.lexsort((ids, ~scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.k:
                self.low = max(self.low, int(self.scores[-1]))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores n with low * positive <= 100 n <= high * positive."""
    return max(LEAST, -(-low * positive // 100)), min(2**63 - 1, high * positive // 100)


def _anchors(uri: str, dim: int):
    for table in stored(uri):
        for own, part, q in by_size(table):
            if own == dim:
                yield from zip(part.drop_columns(["embedding"]).to_pylist(), q)


def _positives(stretch: Stretch, anchors, k: int):
    for a, q in anchors:
        best = Best(k, LEAST if a["floor"] is None else a["floor"])
        for rows, scores in stretch.walk(q, lambda: best.low):
            own = (stretch.labels[rows] == a["label"]) & (stretch.ids[rows] != a["vec_id"])
            best.add(scores[own], stretch.ids[rows[own]])
        yield a, [best]


def _negatives(stretch: Stretch, anchors, k: int, low: int, high: int):
    for a, q in anchors:
        ends = [window(s, low, high) for s in a["scores"]]
        windows = [Best(k, lo if f is None else max(lo, f), hi) for (lo, hi), f in zip(ends, a["floors"] or [None] * len(ends))]
        open_ = [w for w in windows if w.low <= w.high]
        if open_:
            for rows, scores in stretch.walk(q, lambda: min(w.low for w in open_), max(w.high for w in open_)):
                other = stretch.labels[rows] != a["label"]
                s, ids = scores[other], stretch.ids[rows[other]]
                for w in open_:
                    w.add(s, ids)
        yield a, windows


def _rows(found):
    """A batch of (anchor, place, other, score)."""
    cols = [], [], [], []
    for a, lists in found:
        for place, best in enumerate(lists):
            for col, more in zip(cols, ([a["vec_id"]] * len(best.ids), [place] * len(best.ids), best.ids.tolist(), best.scores.tolist())):
                col.extend(more)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["anchor_id", "place", "other", "score"])


_FOUND = "anchor_id long, place int, other long, score long"


def _no_book(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A codebook of one word, for lengths that the training rows don't have."""
    return np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))


def build_index(rows: DataFrame, books: dict) -> DataFrame:
    """Rows (vec_id, label, embedding) with the codewords i and j of their halves, staged in ranges of cells."""

    def run(batches):
        for table in gathered(batches):
            for dim, part, x in by_size(table):
                book = books.get(dim) or _no_book(dim)
                i, j = nearest(x[:, : dim // 2], book[0]), nearest(x[:, dim // 2 :], book[1])
                yield from part.append_column("i", pa.array(i, pa.int32())).append_column("j", pa.array(j, pa.int32())).to_batches()

    spark = rows.sparkSession
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, i int, j int"
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.mapInArrow(run, schema).withColumn("h", F.xxhash64("vec_id"))
    return staged(keyed.repartitionByRange(parts, "i", "j", "h").sortWithinPartitions("i", "j").drop("h"), "multi-index")


def _search(index: DataFrame, books: dict, anchors_uri: str, of, *args) -> DataFrame:
    def run(batches):
        for table in gathered(batches):
            for dim, part, x in by_size(table):
                stretch = Stretch(part["vec_id"].to_numpy(), np.array(part["label"].to_pylist()), x, (part["i"].to_numpy(), part["j"].to_numpy()), books.get(dim) or _no_book(dim))
                yield _rows(of(stretch, _anchors(anchors_uri, dim), *args))

    return index.mapInArrow(run, _FOUND)


def _floors(anchors: DataFrame, sample_uri: str, books: dict, of, k: int, *args) -> DataFrame:
    """``anchors`` with the k-th best score of each of their lists among the sample: ``floors``, null where it has fewer.

    The sample is one stretch a vector length.
    """

    def run(batches):
        stretches = {}
        for near in stored(sample_uri, TRAIN_ROWS):
            for dim, part, x in by_size(near):
                book = books.get(dim) or _no_book(dim)
                stretches[dim] = Stretch(part["vec_id"].to_numpy(), np.array(part["label"].to_pylist()), x, (nearest(x[:, : dim // 2], book[0]), nearest(x[:, dim // 2 :], book[1])), book)
        for table in gathered(batches, 1024):
            for dim, part, q in by_size(table):
                if dim in stretches:
                    rows = zip(part.drop_columns(["embedding"]).to_pylist(), q)
                    floors = [[int(b.scores[-1]) if len(b.ids) == k else None for b in lists] for _, lists in of(stretches[dim], rows, k, *args)]
                else:
                    floors = [None] * part.num_rows
                yield from part.append_column("floors_", pa.array(floors, pa.list_(pa.int64()))).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"{fields}, floors_ array<long>")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, codewords: int = CODEWORDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors``: vec_id, label, embedding. A component counts as floor(256 x) in
    double precision; the score is the integer inner product, higher first, ties to the smaller
    vec_id. An anchor's positives are its first ``positives`` rows of the same label and another
    vec_id; a positive's negatives are the first ``negatives`` rows of another label whose score
    in hundredths is ``low`` to ``high`` times the positive's.

    Rows without vec_id or label, and vectors that are null or hold null or non-finite
    components, take no part; vectors meet those of their own length only. Of anchor rows that
    share a vec_id the one of least label and vector asks; repeated rows are found each. A
    positive score below zero opens no window. Components beyond 2^53 count as that, scores
    beyond long as its end. Codebooks are trained on ``train_rows`` rows at most, every row is
    indexed. An empty table gives an empty one; other columns aren't used.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    plain = [F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"]
    rows = vectors.select(*plain).where(good)
    asking = anchors.select(*plain).where(good).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("vec_id", "a.label", "a.embedding")
    first = sample(rows, train_rows)
    books = {dim: codebooks(x, codewords) for dim, _, x in by_size(first.toArrow()) if dim > 1}  # a bounded sample
    index = build_index(rows, books)

    floors = _floors(asking.withColumn("floor", F.lit(None).cast("long")), first.staged_path, books, _positives, positives)
    asked = staged(floors.select("vec_id", "label", "embedding", F.element_at("floors_", 1).alias("floor")), "anchors")
    near = _search(index, books, asked.staged_path, _positives, positives)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other")
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "score"))).alias("found"))
    opened = asked.drop("floor").join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    opened = opened.select("vec_id", "label", "embedding", F.col("found.other").alias("positive_ids"), F.col("found.score").alias("scores"), F.lit(None).cast("array<long>").alias("floors"))
    windows = staged(_floors(opened, first.staged_path, books, _negatives, negatives, low, high).drop("floors").withColumnRenamed("floors_", "floors"), "windows")

    far = _search(index, books, windows.staged_path, _negatives, negatives, low, high)
    inside = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other")
    far = far.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= negatives)
    pairs = windows.select(F.col("vec_id").alias("anchor_id"), "scores", F.posexplode("positive_ids").alias("place", "positive_id"))
    pairs = pairs.select("anchor_id", "place", "positive_id", F.get("scores", "place").alias("positive_score"))
    out = far.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = staged(out, "hard-negatives")
    for used in (first, index, asked, windows):
        discard(used)
    return out
