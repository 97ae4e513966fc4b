"""Attributions of a fitted model's output against a background sample (X2, X3, X4, X12).

A record's value of a coalition S of features is v(S) = mean over the background rows b of f(x on S, b elsewhere), so the
expected value is the mean prediction over the background, v({}).

* ``kernel_attribution``: weighted least squares over coalitions drawn by the Shapley kernel, with the efficiency constraint.
  All records share one drawn design, so the solution of the normal equations is one matrix and a record's values are a
  sum over its coalitions, merged like any aggregate.
* ``permutation_attribution``: random feature orders in antithetic pairs, walked one feature at a time; a standard error
  for each record and feature decides for each record when to stop. F + 1 model rows an order, whatever F is. Its background
  may be a whole table (``whole_background``): equal feature rows are one row with a weight, on both sides, and the blocks of
  different records and of different background rows meet in tasks of their own. Work grows with the product of the two numbers
  of different rows, which for features of few values do not grow with the table.
* ``tree_attribution``: closed-form Shapley weights of (record, background row, leaf) from the intervals that a leaf's path
  puts on features; no coalition rows.
* ``linear_attribution``: w_j (x_j - mean of b_j) in the margin of a linear model.
* ``exact_attribution``: all 2^F coalitions, for up to 16 features; the others are held against it.

Records are partitioned by key once; coalition rows are made by generators (no join) and added up by key in the same
partition, in one aggregate that holds one row a record. Of a model whose inputs meet in one affine layer (logistic
regression, perceptron), the coalitions of a batch of records are values of that layer, added up and put through the rest
of the model as arrays (``affine_probability``); they never become rows. A sampled background (at most ``BACKGROUND`` rows) and the drawn coalitions are bounded by parameters and travel as
one scalar subquery; a fitted forest travels as one broadcast, as it does in MLlib's own prediction.

Defined results: an empty set of records gives no rows; records are told apart by their key, which must be unique (as in the
prepared frame); constant models get zeros; a background without rows is an error.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir, shuffle_partitions

BACKGROUND = 50
#: array cells that a task works on at a time
CELLS = 1 << 18
#: different records and different background rows of a block of a whole background
BLOCK_ROWS, BLOCK_BACKGROUND = 128, 512
#: records of a task of ``tree_attribution`` and of one pass over the leaves
TREE_ROWS = 8192
#: a leaf's values are tabulated for all patterns of up to so many features on its path
PATTERN_BITS = 10
#: decimals kept of a value, so that it doesn't depend on the order of summation
DIGITS = 12

Score = Callable[[Model, DataFrame], DataFrame]


def probability(model: Model, df: DataFrame) -> DataFrame:
    """``df`` (with features) and its P(class 1) as ``f``."""
    return model.transform(df).withColumn("f", vector_to_array("probability")[1])


def margin(model: Model, df: DataFrame) -> DataFrame:
    """``df`` (with features) and its raw margin of class 1 as ``f``."""
    return model.transform(df).withColumn("f", vector_to_array("rawPrediction")[1])


def vectors(df: DataFrame, key: str, names: list) -> DataFrame:
    """(key, x): the features as an array, partitioned by key."""
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x")
    return df.select(key, x).repartition(shuffle_partitions(df.sparkSession), key)


def sample_background(df: DataFrame, key: str, names: list, k: int = BACKGROUND, seed: int = 42) -> list:
    """The feature rows of at most ``k`` records, those first in a seeded hash order (a bounded sample)."""
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x")
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).select(x).collect()
    if not rows:
        raise ValueError("the background has no rows")
    return [list(r.x) for r in rows]


def whole_background(df: DataFrame, names: list) -> DataFrame:
    """(x, w): every different feature row of ``df`` and how many records have it."""
    ensure_checkpoint_dir(df.sparkSession)
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x")
    return df.select(x).groupBy("x").agg(F.count(F.lit(1)).alias("w")).checkpoint(eager=True)


def _constant(df: DataFrame, value: list, kind: str) -> Column:
    """A bounded list as a scalar subquery (one value that every task gets)."""
    return df.sparkSession.createDataFrame([(value,)], f"v {kind}").select("v").scalar()


def expected_value(df: DataFrame, model: Model, background: list, score: Score = probability) -> DataFrame:
    """One row: the mean output over the background."""
    b = df.sparkSession.createDataFrame([(r,) for r in background], "x array<double>")
    return score(model, b.select(array_to_vector("x").alias("features"))).agg(F.avg("f").alias("expected_value"))


def _mixed(z: Column, x: Column, b: Column, nf: int) -> Column:
    """x where z is 1, b elsewhere, as a vector."""
    return array_to_vector(F.array(*[F.when(F.get(z, F.lit(j)) == 1, F.get(x, F.lit(j))).otherwise(F.get(b, F.lit(j))) for j in range(nf)]))


def _named(df: DataFrame, names: list) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.col("feature_ord"))


# ---- models that begin with an affine layer -----------------------------------------------------------------------------

def affine_probability(model: Model) -> tuple | None:
    """(weights, offset, rest) of a binary model: P(class 1) of the features x is rest(x @ weights + offset). None for
    other kinds of models."""
    def sigmoid(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):  # exp(-h) = inf is a probability of 0
            return 1 / (1 + np.exp(-h))

    if type(model) is LogisticRegressionModel and model.numClasses == 2:
        return model.coefficients.toArray()[:, None], np.array([model.intercept]), lambda h: sigmoid(h[..., 0])
    if type(model) is not MultilayerPerceptronClassificationModel or model.numClasses != 2:
        return None
    sizes, flat, at, layers = list(model.getLayers()), model.weights.toArray(), 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        end = at + n_in * n_out
        layers.append((flat[at:end].reshape(n_in, n_out), flat[end:end + n_out]))
        at = end + n_out
    (first, offset), later = layers[0], layers[1:]

    def rest(h: np.ndarray) -> np.ndarray:
        for w, b in later:
            h = sigmoid(h) @ w + b
        return sigmoid(h[..., 1] - h[..., 0])  # softmax of two

    return first, offset, rest


def _chunks(n: int, cells: int):
    """Slices of n records, of which each takes ``cells`` array cells in one step."""
    size = max(1, CELLS // max(cells, 1))
    return (slice(i, i + size) for i in range(0, n, size))


def _record_batch(batch: pa.RecordBatch, kept: int, values: np.ndarray, names: list) -> pa.RecordBatch:
    """The batch's first ``kept`` columns and each record's array of values."""
    n, nf = values.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * nf, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.RecordBatch.from_arrays([batch.column(i) for i in range(kept)] + [lists], names=names)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# ---- coalitions: exact and kernel -------------------------------------------------------------------------------------

def _coalition_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list, masks: np.ndarray, weights: np.ndarray,
                           score: Score, digits: int = DIGITS) -> DataFrame:
    """phi_j = sum over coalitions s of weights[j, s] * v(s); the first mask is the empty coalition."""
    x = vectors(rows, key, names)
    affine = affine_probability(model) if score is probability else None
    if affine is not None:
        phi = _affine_coalitions(x, affine, key, background, masks, weights)
    else:
        zs = _constant(x, masks.astype(int).tolist(), "array<array<int>>")
        ws = _constant(x, weights.T.tolist(), "array<array<double>>")
        bs = _constant(x, background, "array<array<double>>")
        made = x.select(key, "x", F.posexplode(zs).alias("s", "z")).select(key, "s", "x", "z", F.explode(bs).alias("b"))
        f = score(model, made.select(key, "s", _mixed(F.col("z"), F.col("x"), F.col("b"), len(names)).alias("features"))).select(key, "f", "s", F.get(ws, F.col("s")).alias("w"))
        n = F.count_if(F.col("s") == 0)  # rows of a coalition: one for each background row
        sums = [F.sum(F.get("w", F.lit(j)) * F.col("f")) / n for j in range(len(names))]
        base = F.sum(F.when(F.col("s") == 0, F.col("f"))) / n  # a record's own copy of the same number
        phi = f.groupBy(key).agg(F.array(*sums).alias("phi"), base.alias("expected_value"))
    phi = phi.select(key, F.posexplode("phi").alias("feature_ord", "contribution"), "expected_value")
    return phi.select(key, _named(phi, names).alias("feature"), "feature_ord", F.round("contribution", digits).alias("contribution"),
                      F.round("expected_value", digits).alias("expected_value"))


def _affine_coalitions(x: DataFrame, affine: tuple, key: str, background: list, masks: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(key, phi, expected_value) of coalitions: the record's part of the first layer and the background's are added."""
    w, offset, rest = affine
    b, z = np.array(background, float), np.array(masks, float)
    nf = z.shape[1]
    others = [(b * (1 - on)) @ w + offset for on in z]
    expected = float(rest(others[0]).mean())

    def values(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column(1), nf)
            phi = np.zeros(own.shape)
            for part in _chunks(len(own), len(b) * w.shape[1]):
                for on, other, c in zip(z, others, weights.T):
                    v = rest(((own[part] * on) @ w)[:, None, :] + other[None]).mean(axis=1)
                    phi[part] += v[:, None] * c[None]
            yield _record_batch(batch, 1, phi, [key, "phi"])

    out = x.mapInArrow(values, f"`{key}` {x.schema[key].dataType.simpleString()}, phi array<double>")
    return by_key(out, [key], "phi", nf, F.avg).withColumn("expected_value", F.lit(expected))


def by_key(df: DataFrame, keys: list, col: str, n: int, agg) -> DataFrame:
    """``agg`` of the arrays (of ``n`` values) of each key, place by place: as all rows of a key count as one record."""
    return df.groupBy(*keys).agg(F.array(*[agg(F.get(col, F.lit(i))) for i in range(n)]).alias(col))


def _all_masks(nf: int) -> np.ndarray:
    return (np.arange(2 ** nf)[:, None] >> np.arange(nf)[None, :]) & 1


def exact_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list, score: Score = probability, digits: int = DIGITS) -> DataFrame:
    """Shapley values over all coalitions (up to 16 features): (key, feature, feature_ord, contribution, expected_value)."""
    nf = len(names)
    if nf > 16:
        raise ValueError("all coalitions are for up to 16 features; kernel_attribution and permutation_attribution draw them")
    masks = _all_masks(nf)
    size = masks.sum(axis=1)
    w = np.array([math.factorial(s) * math.factorial(nf - s - 1) / math.factorial(nf) for s in range(nf)])
    weights = np.where(masks == 1, w[np.maximum(size - 1, 0)][:, None], -w[np.minimum(size, nf - 1)][:, None]).T
    return _coalition_attribution(rows, model, key, names, background, masks, weights, score, digits)


def kernel_design(nf: int, samples: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (without the empty and the full one) and their least-squares weights: all of them with the Shapley
    kernel's weight if there are at most ``samples``, else drawn by it, each with its complement."""
    if 2 ** nf - 2 <= samples:
        masks = _all_masks(nf)[1:-1]
        size = masks.sum(axis=1)
        return masks, np.array([(nf - 1) / (math.comb(nf, int(s)) * s * (nf - s)) for s in size]).reshape(-1)
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, nf)
    chance = 1 / (sizes * (nf - sizes))
    drawn: dict = {}
    for s in rng.choice(sizes, size=-(-samples // 2), p=chance / chance.sum()):
        z = np.zeros(nf, int)
        z[rng.permutation(nf)[:s]] = 1
        for m in (z, 1 - z):
            drawn[tuple(m)] = drawn.get(tuple(m), 0) + 1
    return np.array(list(drawn)), np.array(list(drawn.values()), float)


def kernel_weights(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The matrix that turns v of ({}, the masks, all features) into the constrained least-squares solution."""
    nf = masks.shape[1]
    zw = masks.T * weights
    a = np.linalg.pinv(zw @ masks)
    one = a.sum(axis=1) / a.sum()
    p = a @ zw - np.outer(one, (a @ zw).sum(axis=0))  # of v(S) - v({}); what is missing to efficiency is spread by ``one``
    return np.hstack([-(p.sum(axis=1) + one)[:, None], p, one[:, None]]).reshape(nf, -1)


def kernel_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list, samples: int = 100, seed: int = 42,
                       score: Score = probability) -> DataFrame:
    """Kernel values of every record from at most ``samples`` coalitions; sums to f(x) - expected_value exactly."""
    nf = len(names)
    if nf == 1:
        return exact_attribution(rows, model, key, names, background, score)
    masks, w = kernel_design(nf, samples, seed)
    whole = np.vstack([np.zeros((1, nf), int), masks, np.ones((1, nf), int)])
    return _coalition_attribution(rows, model, key, names, background, whole, kernel_weights(masks, w), score)


# ---- linear ---------------------------------------------------------------------------------------------------------------

def linear_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list) -> DataFrame:
    """(key, feature, feature_ord, contribution, expected_value) of a fitted linear model's margin: one projection of the records."""
    mean, w = np.mean(np.array(background, float), axis=0), model.coefficients.toArray()
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(j).alias("feature_ord"),
                               F.round(F.lit(float(w[j])) * (F.col(f"`{n}`").cast("double") - F.lit(float(mean[j]))), DIGITS).alias("contribution")) for j, n in enumerate(names)])
    return rows.select(key, F.inline(parts)).withColumn("expected_value", F.round(F.lit(float(model.intercept + w @ mean)), DIGITS))


# ---- random orders ------------------------------------------------------------------------------------------------------

def _rounds(x: DataFrame, model: Model, key: str, nf: int, background: list | DataFrame, first: int, count: int, seed: int, score: Score) -> DataFrame:
    """(key, round, feature_ord, phi): each round walks a random order and its reverse for every background row."""
    affine, whole = affine_probability(model) if score is probability else None, isinstance(background, DataFrame)
    if affine is not None:
        return (_affine_blocks if whole else _affine_rounds)(x, affine, key, nf, background, first, count, seed)
    rounds = x.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
    if whole:
        total = background.agg(F.sum("w")).first()[0]
        rounds = rounds.crossJoin(background.select(F.xxhash64("x").alias("i"), F.col("x").alias("b"), (F.col("w") / total).alias("share")))
    else:
        bs = _constant(x, background, "array<array<double>>")
        rounds = rounds.select("*", F.posexplode(bs).alias("i", "b")).withColumn("share", F.lit(1 / len(background)))
    draw = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), F.col(key), "round", "i", j).alias("h"), j.alias("j")))
    order = F.transform(F.array_sort(draw), lambda s: s["j"])
    both = rounds.withColumn("order", order).withColumn("order", F.explode(F.array("order", F.reverse("order"))))
    steps = both.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(nf))))  # the first t features of the order are the record's
    z = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)), lambda j: (F.array_position("order", j) <= F.col("t")).cast("int"))
    rows = steps.withColumn("features", _mixed(z, F.col("x"), F.col("b"), nf)).select(key, "round", "t", "order", "share", "features")
    # step t is the end of one feature's move and the start of the next one's
    moves = F.array(F.struct(F.get("order", F.col("t") - 1).alias("feature_ord"), F.col("f").alias("d")), F.struct(F.get("order", F.col("t")).alias("feature_ord"), (-F.col("f")).alias("d")))
    terms = score(model, rows).select(key, "round", "share", F.inline(F.filter(moves, lambda m: m["feature_ord"].isNotNull())))
    return terms.groupBy(key, "round", "feature_ord").agg((F.sum(F.col("d") * F.col("share")) / 2).alias("phi"))


def _affine_rounds(x: DataFrame, affine: tuple, key: str, nf: int, background: list, first: int, count: int, seed: int) -> DataFrame:
    """The rounds of a model that begins with an affine layer: a feature's move changes that layer by its difference."""
    w, offset, rest = affine
    b = np.array(background, float)
    nb = len(b)
    rounds = x.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
    draw = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(nf - 1)), lambda j: F.xxhash64(F.lit(seed), F.col(key), "round", i, j))))

    def values(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, draws = _matrix(batch.column(2), nf), _matrix(batch.column(3), nb * nf)
            phi = np.zeros(own.shape)
            for part in _chunks(len(own), nb * max(nf, w.shape[1])):
                order = np.argsort(draws[part].reshape(-1, nb, nf), axis=2, kind="stable")
                gap = own[part][:, None, :] - b[None]
                at = np.arange(len(order))
                for way in (order, order[:, :, ::-1]):
                    h = np.broadcast_to(b @ w + offset, (len(order), nb, w.shape[1])).copy()
                    f = rest(h)
                    for t in range(nf):
                        j = way[:, :, t]
                        h += np.take_along_axis(gap, j[:, :, None], axis=2) * w[j]
                        after = rest(h)
                        for i in range(nb):
                            phi[part][at, j[:, i]] += (after - f)[:, i]
                        f = after
            yield _record_batch(batch, 2, phi / (2 * nb), [key, "round", "phi"])

    out = rounds.select(key, "round", "x", draw.alias("draw")).mapInArrow(
        values, f"`{key}` {x.schema[key].dataType.simpleString()}, round int, phi array<double>")
    out = out.repartition(shuffle_partitions(x.sparkSession), key)  # what follows is grouped by the key and more
    return by_key(out, [key, "round"], "phi", nf, F.sum).select(key, "round", F.posexplode("phi").alias("feature_ord", "phi"))


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _blocks(rows: DataFrame, x: str, w: Column, size: int, seed: int, name: str) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``size``: (name, its rows' features, weights and hashes as arrays), and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    h = F.xxhash64(F.lit(seed), F.lit(name), F.col(x))
    packed = rows.groupBy(F.pmod(h, F.lit(n)).cast("int").alias(name)).agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), F.col(x).alias("x"), w.cast("double").alias("w")))).alias("r"))
    return packed.select(name, F.flatten("r.x").alias(f"{name}_x"), F.col("r.w").alias(f"{name}_w"), F.col("r.h").alias(f"{name}_h")), n


def _affine_blocks(x: DataFrame, affine: tuple, key: str, nf: int, background: DataFrame, first: int, count: int, seed: int) -> DataFrame:
    """The rounds against a whole background of a model that begins with an affine layer, by pairs of blocks. ``key`` is the
    feature row itself. An order follows from the seed, the round and the two rows."""
    w, offset, rest = affine
    parts = shuffle_partitions(x.sparkSession)
    total = background.agg(F.sum("w")).first()[0]
    own, n = _blocks(x, "x", F.lit(1), BLOCK_ROWS, seed, "own")
    other, m = _blocks(background, "x", F.col("w"), BLOCK_BACKGROUND, seed, "other")
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).join(other.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["own", "other"])

    def values(batches):
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            for r in range(batch.num_rows):
                at = {c: col[c][r].values.to_numpy(zero_copy_only=False) for c in ("own_x", "own_h", "other_x", "other_w", "other_h")}
                xs, b, share = at["own_x"].reshape(-1, nf), at["other_x"].reshape(-1, nf), at["other_w"] / total
                hx, hb = at["own_h"].view(np.uint64), _mix(at["other_h"].view(np.uint64))
                start = b @ w + offset
                phis = []
                for k in range(first, first + count):
                    phi = np.zeros(xs.shape)
                    for part in _chunks(len(xs), len(b) * max(nf, w.shape[1])):
                        with np.errstate(over="ignore"):
                            draws = _mix((hx[part] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))[:, None] ^ hb[None])
                            draws = _mix(draws[:, :, None] + np.arange(1, nf + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                        order = np.argsort(draws, axis=2, kind="stable")
                        gap = xs[part][:, None, :] - b[None]
                        place = np.arange(len(order))[:, None] * nf
                        for way in (order, order[:, :, ::-1]):
                            h = np.broadcast_to(start, (len(order), *start.shape)).copy()
                            f = rest(h)
                            for t in range(nf):
                                j = way[:, :, t]
                                h += np.take_along_axis(gap, j[:, :, None], axis=2) * w[j]
                                after = rest(h)
                                phi[part] += np.bincount((place + j).ravel(), ((after - f) * share).ravel(), len(order) * nf).reshape(-1, nf)
                                f = after
                    phis.append(phi / 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count * len(xs) + 1) * nf, pa.int32()), pa.array(np.concatenate(phis).ravel()))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(count * len(xs) + 1) * nf, pa.int32()), pa.array(np.tile(xs, (count, 1)).ravel()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.repeat(np.arange(first, first + count), len(xs)), pa.int32()), lists], names=[key, "round", "phi"])

    out = pairs.repartition(parts, "own", "other").mapInArrow(values, f"`{key}` array<double>, round int, phi array<double>")
    return by_key(out, [key, "round"], "phi", nf, F.sum).select(key, "round", F.posexplode("phi").alias("feature_ord", "phi"))


def permutation_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list | DataFrame, error: float = 0.01, batch: int = 4, most: int = 64,
                            seed: int = 42, score: Score = probability) -> DataFrame:
    """(key, feature, feature_ord, contribution, std_error, rounds, expected_value). Rounds are made ``batch`` at a time for the
    records of which some feature's standard error is still above ``error``, up to ``most`` rounds. Every round uses each
    background row once (of a whole background: each different row once, by its weight), so the values add up to
    f(x) - expected_value whatever has been drawn. With a whole background, equal feature rows are worked out once and share
    their orders; rows of one key add up, as with a list (their errors add up to a bound)."""
    spark, nf = rows.sparkSession, len(names)
    ensure_checkpoint_dir(spark)
    x = vectors(rows, key, names).checkpoint(eager=True)
    n, s = F.col("n"), F.col("s")
    err = F.sqrt(F.greatest(F.col("q") - s * s / n, F.lit(0.0)) / (n - 1) / n)
    if isinstance(background, DataFrame):
        if not background.head(1):
            raise ValueError("the background has no rows")
        base = score(model, background.select(array_to_vector("x").alias("features"), "w")).agg((F.sum(F.col("f") * F.col("w")) / F.sum("w")).alias("expected_value")).scalar()
        each = x.select("x").distinct().select(F.col("x").alias("_row"), "x").checkpoint(eager=True)
        done = _walked(each, model, "_row", nf, background, error, batch, most, seed, score)
        done = done.select("_row", "feature_ord", (s / n).alias("phi"), err.alias("err"), "n")
        done = x.join(done, F.col("x") == F.col("_row")).groupBy(key, "feature_ord").agg(F.sum("phi").alias("phi"), F.sum("err").alias("err"), F.max("n").alias("n"))
    else:
        base = expected_value(x, model, background, score).scalar()
        done = _walked(x, model, key, nf, background, error, batch, most, seed, score).select(key, "feature_ord", (s / n).alias("phi"), err.alias("err"), "n")
    return done.select(key, _named(done, names).alias("feature"), "feature_ord", F.round("phi", DIGITS).alias("contribution"), F.round("err", DIGITS).alias("std_error"),
                       n.alias("rounds"), F.round(base, DIGITS).alias("expected_value"))


def _walked(x: DataFrame, model: Model, key: str, nf: int, background: list | DataFrame, error: float, batch: int, most: int, seed: int, score: Score) -> DataFrame:
    """(key, feature_ord, n, s, q): number, sum and sum of squares of the values of the rounds that each record needed."""
    done, todo, at = None, x, 0
    while True:
        new = _rounds(todo, model, key, nf, background, at, batch, seed, score)
        at += batch
        sums = new.groupBy(key, "feature_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("phi").alias("s"), F.sum(F.col("phi") * F.col("phi")).alias("q"))
        done = (sums if done is None else done.unionByName(sums).groupBy(key, "feature_ord").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])).checkpoint(eager=True)
        if at >= most:
            return done
        spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
        open_ = done.groupBy(key).agg(F.max(F.sqrt(spread / (F.col("n") - 1) / F.col("n"))).alias("e"), F.max("n").alias("n")).where((F.col("e") > error) & (F.col("n") == at))
        todo = x.join(open_, key, "left_semi").checkpoint(eager=True)
        if not todo.head(1):
            return done


# ---- trees ----------------------------------------------------------------------------------------------------------------

class Leaf:
    """A leaf's value and the interval (low, high] that its path leaves to each feature on it."""

    def __init__(self, value: float, low: dict, high: dict):
        self.value = value
        self.features = sorted(low.keys() | high.keys())
        self.low = [low.get(j, -np.inf) for j in self.features]
        self.high = [high.get(j, np.inf) for j in self.features]

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """Which of the path's features each record meets, as bits of a number. ``x`` holds a feature a row."""
        out = np.zeros(x.shape[1], np.int64)
        for i, (j, low, high) in enumerate(zip(self.features, self.low, self.high)):
            if low == -np.inf:
                met = x[j] <= high
            elif high == np.inf:
                met = x[j] > low
            else:
                met = (x[j] > low) & (x[j] <= high)
            out += met.astype(np.int64) << i
        return out


def _bits(patterns: np.ndarray, k: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(k)) & 1).astype(float)


def node_table(model: Model) -> DataFrame:
    """The nodes of a fitted forest or boosted model, as MLlib's writer stores them: (tree, weight, node fields)."""
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    trees = spark.read.parquet(os.path.join(path, "treesMetadata")).toDF("tree", "metadata", "weight").select("tree", "weight")
    nodes = spark.read.parquet(os.path.join(path, "data")).toDF("tree", "node").select("tree", "node.*")
    return nodes.join(trees, "tree")


def leaves(model: Model, boosted: bool) -> list[Leaf]:
    """All leaves with the value that each adds to the output: the weighted prediction (``boosted``: to the margin), or the
    share of class 1 over the number of trees (to the probability). As many as the model has."""
    rows = node_table(model).orderBy("tree", "id").collect()
    nodes = {(r.tree, r.id): r for r in rows}
    trees = sorted({r.tree for r in rows})
    out = []
    for tree in trees:
        todo = [(nodes[tree, 0], {}, {})]
        while todo:
            r, low, high = todo.pop()
            if r.leftChild < 0:
                share = r.impurityStats[1] / sum(r.impurityStats) / len(trees) if not boosted else r.weight * r.prediction
                if low or high:
                    out.append(Leaf(share, low, high))
                continue
            j, t = r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]
            if r.split.numCategories != -1:
                raise ValueError("splits on categorical features are not supported; the prepared features are all numbers")
            todo.append((nodes[tree, r.leftChild], low, {**high, j: min(t, high.get(j, np.inf))}))
            todo.append((nodes[tree, r.rightChild], {**low, j: max(t, low.get(j, -np.inf))}, high))
    return out


def _leaf_values(a: np.ndarray, leaf: Leaf, c: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The leaf's Shapley values for records that meet its path's features as the rows of ``a`` say. Of these features, u are met
    by the record alone and v by the background row alone: the leaf is reached by coalitions that hold all of the u and none
    of the v, so each of the u gets (u - 1)! v! / (u + v)! and each of the v the negative of u! (v - 1)! / (u + v)!.
    ``c``: the different rows of "the background meets the feature", ``share``: how much of the background has each."""
    alive = ((1 - a) @ (1 - c).T) == 0
    u, v = a @ (1 - c).T, (1 - a) @ c.T
    fact = np.cumprod(np.concatenate([[1.0], np.arange(1, len(leaf.features) + 1)]))
    ui, vi = u.astype(int), v.astype(int)
    whole = fact[np.minimum(ui + vi, len(fact) - 1)]
    scale = alive * (leaf.value * share)[None, :]
    plus = scale * fact[np.maximum(ui - 1, 0)] * fact[vi] / whole
    minus = scale * fact[ui] * fact[np.maximum(vi - 1, 0)] / whole
    return a * (plus @ (1 - c)) - (1 - a) * (minus @ c)


def _tree_values(x: np.ndarray, parts: list) -> np.ndarray:
    """Shapley values of the records ``x`` (a feature a row) over all leaves. A record's values of a leaf depend only on which
    of the path's features it meets, so they are worked out once a pattern and looked up."""
    phi = np.zeros(x.shape)
    for leaf, seen, share in parts:
        k, at = len(leaf.features), leaf.pattern(x)
        if k <= PATTERN_BITS:
            patterns = np.arange(2 ** k)
        else:
            patterns, at = np.unique(at, return_inverse=True)
        table = _leaf_values(_bits(patterns, k), leaf, _bits(seen, k), share)
        for i, j in enumerate(leaf.features):
            phi[j] += table[:, i][at]
    return phi


def tree_attribution(rows: DataFrame, model: Model, key: str, names: list, background: list, boosted: bool = False) -> DataFrame:
    """(key, feature, feature_ord, contribution, expected_value) of a forest's probability or a boosted model's margin."""
    out = tree_arrays(rows, model, key, names, background, boosted)
    base = expected_value(rows, model, background, margin if boosted else probability).scalar()
    out = out.select(key, F.posexplode("phi").alias("feature_ord", "contribution"))
    return out.select(key, _named(out, names).alias("feature"), "feature_ord", F.round("contribution", DIGITS).alias("contribution"),
                      F.round(base, DIGITS).alias("expected_value"))


def tree_arrays(rows: DataFrame, model: Model, key: str, names: list, background: list, boosted: bool = False) -> DataFrame:
    """(key, phi): the same, one array a record."""
    b = np.array(background, float).T
    nf = len(names)
    parts = []
    for leaf in leaves(model, boosted):
        seen, n = np.unique(leaf.pattern(b), return_counts=True)
        parts.append((leaf, seen, n / b.shape[1]))
    shared = rows.sparkSession.sparkContext.broadcast(parts)  # bounded by the model's leaves and the background
    kind = rows.schema[key].dataType.simpleString()

    def values(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(_matrix(batch.column(1), nf).T)
            phi = np.concatenate([_tree_values(x[:, i:i + TREE_ROWS], shared.value) for i in range(0, x.shape[1], TREE_ROWS)], axis=1)
            yield _record_batch(batch, 1, phi.T, [key, "phi"])

    x = rows.select(key, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x"))
    # every task passes over all leaves: few, full tasks, but no fewer than the records need
    x = x.repartition(max(1, -(-rows.count() // TREE_ROWS)), key)
    return x.mapInArrow(values, f"`{key}` {kind}, phi array<double>")
