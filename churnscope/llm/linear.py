"""Cumulative-link models on hashed presence features, fitted by Spark.

A text becomes the set of hashes of its words (and, if asked for, of its punctuation runs and a
few binned shares), each one of 2**BITS features that is either there or not. One weight vector
is shared by all grades; ordered thresholds t_1 < t_2 < ... give P(grade >= j) = sigmoid(w.x - t_j).
Two grades are plain logistic regression.

Fitting reads a written table of the features of a bounded sample of labelled rows. Each step of
the optimiser (Adam on the whole sample) is one Spark job: every task returns the gradient of its
rows, the driver adds at most ``PARTS`` of them. A row may carry a second,
counterfactual feature set; the squared difference of the two scores is then penalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import text as X
from churnscope.llm.store import bounded_batches, written

BITS = 18
DIM = 1 << BITS
#: rows of the labelled sample that fitting reads at most
SAMPLE_ROWS = 20_000
PARTS = 8
#: z-score from which a feature gets a weight by default: the universal threshold, which the largest of DIM chance scores hardly reaches
SCREEN = float(np.sqrt(2 * np.log(DIM)))

_PUNCT = (X._b > 32) & (X._b < 127) & ~X.ALNUM_WORD
_UPPER = (X._b >= 65) & (X._b <= 90)


def feature_sets(texts: pa.Array, shape: bool = False):
    """Yield (first row, rows, row of each feature, feature): distinct features of each text, sorted by row.
    ``shape``: also punctuation runs and binned shares of characters and of distinct words."""
    mask = np.uint64(DIM - 1)
    for lo, buf, offs in X.chunks(texts):
        low, n = X.LOWER[buf], len(offs) - 1
        s, e, doc = X.word_spans(buf, offs, X.ALNUM_WORD)
        h = X.word_hashes(low, s, e)
        rows, feats = [doc], [h & mask]
        if shape:
            ps, pe, pdoc = X.word_spans(buf, offs, _PUNCT)
            rows.append(pdoc)
            feats.append(X.mix(X.word_hashes(low, ps, pe) + np.uint64(1)) & mask)
            size = np.maximum(np.diff(offs), 1)
            words = np.bincount(doc, minlength=n)
            pairs = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (h & mask))
            distinct = np.bincount((pairs >> np.uint64(BITS)).astype(np.int64), minlength=n)
            share = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[buf])])[offs]) / size
            bins = [np.minimum(20 * share(_UPPER), 9), np.minimum(20 * share(_PUNCT), 9),
                    10 * distinct / np.maximum(words, 1), np.log2(words + 1)]
            for i, b in enumerate(bins):
                rows.append(np.arange(n))
                feats.append(X.mix(np.uint64(1000 * (i + 1)) + b.astype(np.uint64)) & mask)
        key = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(feats))
        yield lo, n, (key >> np.uint64(BITS)).astype(np.int64), (key & mask).astype(np.int32)


def features(text: Column, shape: bool = False) -> Column:
    """array<int>: the distinct features of a text."""

    def f(texts: pa.Array) -> pa.Array:
        counts, values = np.zeros(len(texts), np.int64), []
        for lo, n, row, feat in feature_sets(texts, shape):
            counts[lo:lo + n] = np.bincount(row, minlength=n)
            values.append(feat)
        offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(values or [np.zeros(0, np.int32)])))

    return F.arrow_udf(f, T.ArrayType(T.IntegerType()))(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, grade) of at most ``rows`` labelled ids, those with the lowest hash among the ids that ``learn`` allows: one row
    an id. An id with several labels takes the largest, one with several documents its smallest text."""
    bounded_batches(docs.sparkSession)
    ids = (labels.select("doc_id", grade.alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & learn)
           .groupBy("doc_id").agg(F.max("grade").alias("grade"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")


class Model:
    """Weights and ordered thresholds."""

    def __init__(self, w: np.ndarray, thresholds: np.ndarray):
        self.w, self.thresholds = w.astype(np.float32), thresholds


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _offsets(lists: pa.ListArray):
    o = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[o[0]:o[-1]], o - o[0]


def _margins(w, idx, o):
    c = np.concatenate([[0.0], np.cumsum(w[idx], dtype=np.float64)])
    return c[o[1:]] - c[o[:-1]]


def _gradient(w, t, y, z):
    """d(-log-likelihood)/d(margin) of each row, and by threshold."""
    k = len(t)
    ge = _sigmoid(z[:, None] - t[None, :])  # P(grade >= 1..k)
    ge = np.concatenate([np.ones((len(z), 1)), ge, np.zeros((len(z), 1))], axis=1)
    d = ge * (1 - ge)
    i = np.arange(len(z))
    p = np.maximum(ge[i, y] - ge[i, y + 1], 1e-9)
    by_t = np.zeros(k)
    np.add.at(by_t, y[y > 0] - 1, (d[i, y] / p)[y > 0])
    np.add.at(by_t, y[y < k], (-d[i, y + 1] / p)[y < k])
    return -(d[i, y] - d[i, y + 1]) / p, by_t


def _associated(data: DataFrame, total: int, mean: float, var: float, screen: float, always: np.ndarray) -> np.ndarray:
    """The features whose rows' mean grade has a z-score beyond ``screen``, and those of ``always``."""

    def sums(batches):
        n, y = np.zeros(DIM), np.zeros(DIM)
        for b in batches:
            idx, o = _offsets(b.column("features"))
            n += np.bincount(idx, minlength=DIM)
            y += np.bincount(idx, np.repeat(b.column("grade").to_numpy(zero_copy_only=False).astype(float), np.diff(o)), DIM)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (n, y)], names=["n", "y"])

    n, y = np.zeros(DIM), np.zeros(DIM)
    for r in data.select("grade", "features").mapInArrow(sums, "n binary, y binary").collect():
        n += np.frombuffer(bytes(r.n), np.float32)
        y += np.frombuffer(bytes(r.y), np.float32)
    z2 = (y - n * mean) ** 2 / np.maximum(n * var * (1 - n / (total + 1)), 1e-9)
    keep = (n > 0) & (z2 > screen ** 2)
    keep[always] = True
    return np.flatnonzero(keep).astype(np.int32)


def fit(sample: DataFrame, grades: int, steps: int = 40, rate: float = 0.2, l2: float = 1e-4, pair: float = 0.0,
        centre: bool = False, screen: float = SCREEN, always=()) -> Model:
    """Fit on (features, grade[, swapped]) rows; ``pair`` weighs the squared score change between features
    and swapped. Only features whose z-score with the grade is beyond ``screen`` get a weight (0: every one that is seen
    with a score), and those of ``always`` (feature numbers) whatever theirs; the optimiser's vectors hold these alone. ``centre`` (two grades): the threshold is moved to where the sample has the
    fewest errors, so that 0.5 is the best cut. A sample without rows gives a model that scores every text 0.5 at the
    first threshold; a grade that is missing from the sample gets a threshold next to its neighbour's."""
    data = written(sample if "swapped" in sample.columns else sample.withColumn("swapped", F.lit(None).cast("array<int>")), "features")
    data = data.coalesce(PARTS)  # of the written sample; the scan of all documents keeps its own tasks
    counts = {r.grade: r["n"] for r in data.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    k = grades - 1
    t = np.zeros(k)
    if not total:
        return Model(np.zeros(DIM), t)
    mean = sum(g * n for g, n in counts.items()) / total
    keep = _associated(data, total, mean, max(sum(n * (g - mean) ** 2 for g, n in counts.items()) / total, 1e-9),
                       screen, np.asarray(always, np.int64))
    dim = len(keep)

    def narrowed(batches):
        for b in batches:
            cols = [b.column("grade")]
            for name in ("features", "swapped"):
                lists = b.column(name)
                idx, o = _offsets(lists.fill_null([]) if lists.null_count else lists)
                at = np.searchsorted(keep, idx)
                hit = (keep[np.minimum(at, dim - 1)] == idx) if dim else np.zeros(len(idx), bool)
                size = np.diff(np.concatenate([[0], np.cumsum(hit)])[o])
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(at[hit].astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(b.column("swapped").is_valid())], names=["grade", "features", "swapped", "paired"])

    rows = written(data.mapInArrow(narrowed, "grade int, features array<int>, swapped array<int>, paired boolean"), "narrowed").coalesce(PARTS)
    for j in range(1, grades):
        q = (sum(n for g, n in counts.items() if g >= j) + 0.5) / (total + 1)
        t[j - 1] = -np.log(q / (1 - q))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(k))
    w, free = np.zeros(dim), np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    sc, m1, m2 = data.sparkSession.sparkContext, 0.0, 0.0
    for step in range(1, steps + 1):
        th = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        shared = sc.broadcast((w, th))

        def grads(batches, shared=shared):
            w, th = shared.value
            g, gt = np.zeros(dim), np.zeros(k)
            for b in batches:
                y = b.column("grade").to_numpy(zero_copy_only=False).astype(np.int64)
                idx, o = _offsets(b.column("features"))
                z = _margins(w, idx, o)
                dz, by_t = _gradient(w, th, y, z)
                gt += by_t
                if pair:
                    sidx, so = _offsets(b.column("swapped"))
                    has = b.column("paired").to_numpy(zero_copy_only=False)
                    diff = np.where(has, z - _margins(w, sidx, so), 0.0) * pair
                    dz = dz + diff
                    g -= np.bincount(sidx, np.repeat(diff, np.diff(so)), dim)
                g += np.bincount(idx, np.repeat(dz, np.diff(o)), dim)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, gt]).tobytes()], pa.binary())], names=["g"])

        g = sum(np.frombuffer(bytes(r.g), np.float64) for r in rows.mapInArrow(grads, "g binary").collect()) / total
        shared.destroy()
        # thresholds are a first value and positive gaps: the chain rule through the running sum
        tail = np.cumsum(g[dim:][::-1])[::-1]
        full = np.concatenate([g[:dim] + l2 * w, tail[:1], tail[1:] * np.exp(free[1:])])
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.99 * m2 + 0.01 * full * full
        move = rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-4)
        w, free = w - move[:dim], free - move[dim:]
    whole = np.zeros(DIM)
    whole[keep] = w
    th = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    return Model(whole, _best_cut(rows, w, pair > 0) if centre and k == 1 else th)


def _best_cut(rows: DataFrame, w: np.ndarray, swapped: bool) -> np.ndarray:
    """The margin with the fewest errors on the sample and, with ``swapped``, on its counterfactuals, which have their texts'
    grades: a cut between what is left of a term's and its swap's scores is no good one (at most two numbers a row come to
    the driver)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def margins(batches):
        for b in batches:
            idx, o = _offsets(b.column("features"))
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(_margins(shared.value, idx, o))], names=["grade", "z"])
            if swapped:
                idx, o = _offsets(b.column("swapped"))
                other = pa.RecordBatch.from_arrays([b.column("grade"), pa.array(_margins(shared.value, idx, o))], names=["grade", "z"])
                yield other.filter(b.column("paired"))

    x = rows.mapInArrow(margins, "grade int, z double").groupBy("z").agg(
        F.sum("grade").alias("one"), F.count(F.lit(1)).alias("n")).orderBy("z").toPandas()
    one, zero = x["one"].to_numpy(float), (x["n"] - x["one"]).to_numpy(float)
    errors = np.concatenate([[0.0], np.cumsum(one)]) + zero.sum() - np.concatenate([[0.0], np.cumsum(zero)])
    z = np.concatenate([[x["z"].iloc[0] - 1], x["z"].to_numpy(float), [x["z"].iloc[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())  # cut i lies between z[i] and z[i + 1]
    i = best[np.argmax((z[1:] - z[:-1])[best])]
    return np.array([(z[i] + z[i + 1]) / 2])


def tails(text: Column, shared, shape: bool = False) -> Column:
    """array<double>: P(grade >= 1), P(grade >= 2), ... of a text under a broadcast model."""

    def f(texts: pa.Array) -> pa.Array:
        m = shared.value
        z = np.zeros(len(texts))
        for lo, n, row, feat in feature_sets(texts, shape):
            z[lo:lo + n] = np.bincount(row, m.w[feat], n)
        p = _sigmoid(z[:, None] - m.thresholds[None, :])
        k = p.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(z) + 1, k, dtype=np.int32)), pa.array(p.ravel()))

    return F.arrow_udf(f, T.ArrayType(T.DoubleType()))(text)
