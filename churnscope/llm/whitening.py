"""Whitening of embeddings on their leading components, found by QDWH spectral divide and conquer.

1. Usable rows become integer vectors; the fit list is each distinct vector once (partial aggregation before
   the shuffle, so a vector that a third of the rows have costs one row a task).
2. Two passes of Spark over the written fit list: exact integer sums per dimension, then the products of the centred
   entries. A task sends one number for each pair of dimensions; these are added by pair in a shuffle, so the driver
   gets one covariance matrix whatever the number of tasks.
3. The components of the dimension x dimension matrix: the polar factor U of the shifted matrix (QDWH iteration:
   dynamically weighted Halley steps, by QR while ill-conditioned, then by Cholesky) gives the projector (U + I) / 2 on
   the invariant subspace above the shift; an orthonormal basis of it and of its complement split the matrix into two,
   which are split again. Only parts that hold wanted components are split on.
4. The components are broadcast (dimension x number of components) and every row is projected in one scan.

Defined results: rows with a null vector or a null or non-finite entry are dropped, all others (repeated rows and
null ids too) are returned; shorter vectors count as filled up with zeros; a component whose eigenvalue is zero up to
rounding (at most 1e-13 of the largest one) has null ``whitened`` and is left out of the identity error; with no spread
at all ``explained`` is null; ``deviation`` is null where it doesn't fit a long; an empty table gives no rows. A
component's largest entry is positive. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.store import written
from churnscope.llm.vectors import integers, matrix, usable

EPS = np.finfo(np.float64).eps
LONG = 2 ** 63 - 1


# ---- polar factor and spectral splitting of a symmetric matrix ------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix by the QDWH iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = 0.9 / max(np.linalg.norm(np.linalg.inv(np.linalg.qr(x)[1])), 1.0)  # below the smallest singular value
    eye = np.eye(n)
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            x = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            half = np.linalg.solve(np.linalg.cholesky(eye + wc * (x.T @ x)), x.T)  # L^-1 X'
            x = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(np.linalg.cholesky(eye + wc * (before.T @ before)).T, half).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if np.linalg.norm(x - before) <= np.cbrt(5 * EPS) and 1 - low < 10 * EPS:
            break
    return x


def _shifts(a: np.ndarray) -> list:
    """Places around the mean eigenvalue (which has eigenvalues on both sides), the best conditioned shifted matrix first."""
    n = len(a)
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    out = []
    for t in (0.0, 0.01, -0.01, 0.05, -0.05, 0.11, -0.11, 0.19, -0.19):
        r = np.linalg.qr(a - (mean + t * spread) * np.eye(n))[1]
        d = np.abs(np.diag(r))
        if d.min() > EPS * d.max():
            out.append((np.linalg.norm(np.linalg.inv(r)), mean + t * spread))
    return [s for _, s in sorted(out)]


def _split(a: np.ndarray):
    """Orthonormal bases of the invariant subspaces above and below a shift; None if the matrix has one eigenvalue only."""
    n = len(a)
    if n < 2 or np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * n * EPS * max(np.linalg.norm(a), 1e-300):
        return None
    best = None
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:  # all eigenvalues lie on one side of this shift
            continue
        q, _ = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, k)))
        q, _ = np.linalg.qr(projector @ q, mode="complete")  # one subspace step; the rest of Q spans the complement
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = (left, q[:, :k], q[:, k:])
        if left <= 10 * n * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def leading_components(a: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    todo, values, vectors = [((a + a.T) / 2, np.eye(len(a)))], [], []
    while todo and len(values) < top:
        part, basis = todo.pop()
        bases = _split(part)
        if bases is None:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for b in bases[::-1]:  # what lies above the shift is taken first
            sub = b.T @ part @ b
            todo.append(((sub + sub.T) / 2, basis @ b))
    order = np.argsort(-np.array(values), kind="stable")[:top]
    v = np.array(vectors).reshape(-1, len(a))[order].T
    v = v / np.linalg.norm(v, axis=0)
    v = v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    return np.array(values)[order], v


# ---- fitting on Spark -----------------------------------------------------------------------------------------------

@dataclass
class Whitening:
    """n distinct vectors with exact sums per dimension; components (columns) with their eigenvalues; the trace of the
    covariance, and the largest absolute entry of the whitened covariance minus the identity."""

    n: int
    sums: list
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def usable(self) -> np.ndarray:
        return self.values > 1e-13 * max(self.values.max(initial=0), 1e-300)


def deviations(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - S as exact integers (int64, or Python integers where these don't fit)."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if most < 2 ** 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(dev: np.ndarray) -> list:
    """The exact sum of the squares of each row; None beyond a long."""
    if dev.dtype != object and (dev.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2 ** 62:
        return (dev * dev).sum(axis=1).tolist()
    total = [sum(int(y) * int(y) for y in r) for r in dev]
    return [t if t <= LONG else None for t in total]


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x - S / n, rounded once."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def _covariance(fit_list: DataFrame, dim: int, n: int, rows) -> np.ndarray:
    """The mean of the products of the entries that ``rows(x)`` gives for each batch of vectors; their means are taken off."""

    def partial(batches):
        total, mean = np.zeros((dim, dim)), np.zeros(dim)
        for b in batches:
            y = rows(b.column("x"))
            total += y.T @ y
            mean += y.sum(axis=0)
        i, j = np.triu_indices(dim)
        cell = np.concatenate([i * dim + j, dim * dim + np.arange(dim)])
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.concatenate([total[i, j], mean]))], names=["cell", "v"])

    out, mean = np.zeros((dim, dim)), np.zeros(dim)
    for r in fit_list.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        if r.cell < dim * dim:
            out[r.cell // dim, r.cell % dim] = out[r.cell % dim, r.cell // dim] = r.v / n
        else:
            mean[r.cell - dim * dim] = r.v / n
    return out - np.outer(mean, mean)


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the column ``embedding``; None for a table without usable rows."""
    fit_list = written(vectors.where(usable(F.col("embedding"))).select(integers(F.col("embedding")).alias("x")).distinct(), "fit-list")
    size = fit_list.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    if not n or not dim:
        return None

    def sums(batches):
        total = np.zeros(dim, np.int64).astype(object)
        for b in batches:
            x = matrix(b.column("x"), dim)
            small = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2 ** 62
            total = total + (x if small else x.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([str(t) for t in total])], names=["i", "s"])

    got = fit_list.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = [int(r.s) for r in sorted(got, key=lambda r: r.i)]
    cov = _covariance(fit_list, dim, n, lambda x: _centred(matrix(x, dim), n, s))
    values, vecs = leading_components(cov, min(components, dim))
    model = Whitening(n, s, values, vecs, float(np.trace(cov)))
    ok = model.usable()
    if ok.any():
        scale = vecs[:, ok] / np.sqrt(values[ok])
        white = _covariance(fit_list, int(ok.sum()), n, lambda x: _centred(matrix(x, dim), n, s) @ scale)
        model.identity_error = float(np.abs(white - np.eye(int(ok.sum()))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of (vec_id, embedding)
    and component, from 1."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        m: Whitening = shared.value
        dim, k, ok = len(m.sums), len(m.values), m.usable()
        scale = m.components / np.sqrt(np.where(ok, m.values, 1.0))
        for b in batches:
            x = matrix(b.column("x"), dim)
            dev = deviations(x, m.n, m.sums)
            white = (dev / m.n).astype(np.float64) @ scale
            rows = len(x)
            tile = lambda a, t: pa.array(np.tile(a, rows), t)  # noqa: E731, B023
            squares = pa.array(_squares(dev), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            explained = pa.array(np.tile(m.values / m.trace, rows)) if m.trace > 0 else pa.nulls(rows * k, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), tile(np.arange(1, k + 1), pa.int32()),
                                              tile(np.full(k, m.n), pa.int64()), squares, pa.array(white.ravel(), mask=np.tile(~ok, rows)), explained,
                                              tile(np.full(k, m.identity_error), pa.float64())],
                                             names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("x")).mapInArrow(project, schema)
