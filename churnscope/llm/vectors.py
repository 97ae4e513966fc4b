"""Embedding columns as integer vectors, and their rows as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """The vector is there and all its entries are finite numbers (an empty vector is usable)."""
    finite = F.forall(vec, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def integers(vec: Column) -> Column:
    """array<bigint>: floor(256 * x) of each entry, x as double; beyond a long it takes the nearest long."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * 256.0))


def matrix(lists: pa.ListArray, dim: int | None = None) -> np.ndarray:
    """Rows of a list<int64> array as an int64 matrix; shorter rows are filled up with zeros."""
    off = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()[off[0]:off[-1]]
    off = off - off[0]
    size = np.diff(off)
    dim = int(max(size.max(initial=0), dim or 0))
    if len(size) and (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - off[row]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of the rows of ``a`` with the rows of ``b`` (as far as a long holds them)."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
