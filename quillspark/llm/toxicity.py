"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased code points, presence only. Each is scaled by its
log-count ratio r = log((p + a) / |p|_1) - log((q + a) / |q|_1), p and q being the numbers of
toxic and clean training texts with the n-gram. A ratio is drawn towards zero by SIGMAS of its
standard errors, so an n-gram seen too seldom to tell the classes apart has none; all others
are features. Whole texts are counted and scored, never prefixes.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import drop_idle
from .shared import batches_of, staged, text_or_empty

BITS = 18
ORDERS = (3, 4, 5, 6)
#: At most this many labelled rows are learnt from, those with the least hash of doc_id and text.
MAX_TRAIN_ROWS = 8000
SMOOTHING = 1.0
#: Bins of training rows that a step of the regression expands at a time, but for one longer row.
BLOCK = 1 << 19
#: Standard errors by which a log-count ratio is drawn towards zero.
SIGMAS = 3.0
HELD_OUT_OF = 5


def grams(text: str) -> list[np.ndarray]:
    """Hashed n-grams of a whole text, an array for each order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    h = codes
    for n in range(2, ORDERS[-1] + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct bins of a text; only those marked in ``wanted`` if given."""
    found = [g if wanted is None else g[wanted[g]] for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # by bin, log-count ratio included
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[present(text, self.weights != 0)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % HELD_OUT_OF == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows that aren't held out, at most ``max_rows``.

    Rows with a null id or label are left out. Of several labels of an id the greatest
    counts; equal rows count once, texts that share an id are rows of their own. The chosen
    keys are at most ``max_rows``, so they are broadcast.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(~F.coalesce(held_out(), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("part", F.xxhash64("text"))
    chosen = texts.select("doc_id", "part").join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(max_rows)
    return texts.join(F.broadcast(chosen), ["doc_id", "part"]).dropDuplicates(["doc_id", "part"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled rows; an empty or one-sided set gives score 0 or 1 by majority."""
    rows = staged(training_rows(docs, labels, max_rows).repartition(16), "toxicity-train")

    def count(it):
        pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches_of(it):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if toxic else neg)[present(text)] += 1
        bins = np.nonzero(pos + neg)[0]
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(pos[bins], pa.int64()), pa.array(neg[bins], pa.int64())], names=["bin", "pos", "neg"])

    counts = staged(rows.mapInArrow(count, "bin int, pos long, neg long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-counts")
    size = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    n_pos, n_neg = size.get(True, 0), size.get(False, 0)
    weights = np.zeros(1 << BITS, np.float64)
    if not n_pos or not n_neg:
        return Model(weights, 20.0 if n_pos else -20.0)
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    ratio = F.log((F.col("pos") + SMOOTHING) / F.lit(float(total[0] + SMOOTHING))) - F.log((F.col("neg") + SMOOTHING) / F.lit(float(total[1] + SMOOTHING)))
    error = F.sqrt(1 / (F.col("pos") + SMOOTHING) + 1 / (F.col("neg") + SMOOTHING))
    drawn = F.signum("r") * F.greatest(F.abs("r") - SIGMAS * F.col("error"), F.lit(0.0))
    # every bin with a ratio: 2 ** BITS rows at most
    best = counts.select("bin", ratio.alias("r"), error.alias("error")).select("bin", drawn.alias("r")).where("r <> 0").toArrow()
    wanted, ratios = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
    wanted[best["bin"].to_numpy()] = True
    ratios[best["bin"].to_numpy()] = best["r"].to_numpy()

    def encode(it):
        for batch in batches_of(it):
            sets = [present(t, wanted).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), batch.column(1).cast(pa.int32())], names=["bins", "toxic"])

    # at most max_rows sets, each of the bins that have a ratio
    coef, bias = _logistic(rows.mapInArrow(encode, "bins binary, toxic int").toArrow(), ratios)
    weights[:] = ratios * coef
    return Model(weights, bias)


def _logistic(sets: pa.Table, ratios: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows (bins binary, toxic int) at once; rows are put in the order of their content.

    The driver holds the bins once, 4 bytes each; all else is made for some BLOCK of them at a time.
    """
    rows = sorted(zip(sets["bins"].to_pylist(), sets["toxic"].to_pylist()))
    del sets
    y = (np.array([t for _, t in rows]) != 0).astype(float)
    ends = np.cumsum([len(b) // 4 for b, _ in rows])
    cols = np.empty(ends[-1], np.uint32)
    for k, e in enumerate(ends.tolist()):
        found = np.frombuffer(rows[k][0], "<u4")
        cols[e - len(found) : e] = found
        rows[k] = None
    used = np.zeros(len(ratios), bool)
    used[cols] = True
    bins, place = np.nonzero(used)[0], np.cumsum(used, dtype=np.uint32) - 1
    r = ratios[bins]
    sizes, blocks, at = np.diff(ends, prepend=0), [], 0
    while at < len(ends):
        start = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, start + BLOCK, "right")))
        cols[start : ends[to - 1]] = place[cols[start : ends[to - 1]]]
        blocks.append((slice(at, to), slice(start, ends[to - 1])))
        at = to
    w, b = np.zeros(len(bins)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(bins) + 1), np.zeros(len(bins) + 1)
    for t in range(1, rounds + 1):
        g, total, wr = np.zeros(len(bins)), 0.0, w * r
        for own, part in blocks:
            row, col = np.repeat(np.arange(own.stop - own.start), sizes[own]), cols[part]
            z = np.bincount(row, wr[col], own.stop - own.start) + b
            err = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[own]
            g += np.bincount(col, err[row], len(bins))
            total += err.sum()
        g = np.append(g * r / len(y) + decay * w, total / len(y))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros(1 << BITS)
    full[bins] = w
    return full, float(b)


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` double and ``predicted`` int; null texts score as empty ones.

    Columns of these names that ``docs`` already has are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.nonzero(model.weights)[0], model.weights[model.weights != 0], model.bias))

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_idle()
        bins, values, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[bins] = values
        wanted = weights != 0
        for texts in parts:
            # a text at a time: a batch of ten thousand whole texts isn't made Python strings at once
            z = np.array([bias + weights[present(t.as_py(), wanted)].sum() for t in texts], dtype=float)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.withColumn("score", score(text_or_empty())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled rows of ``docs`` that aren't held out, then score all of ``docs``.

    Adds held_out, score and predicted. Null texts are empty; a null doc_id is not held out;
    repeated rows stay; an empty table gives an empty one.
    """
    return score_table(docs, fit(docs, labels, max_rows)).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; the columns stay as they were."""
    model = fit(docs, labels)
    scored = score_table(docs.select(F.struct("*").alias("row"), F.col("text")), model)
    return scored.where("predicted = 0").select("row.*")
