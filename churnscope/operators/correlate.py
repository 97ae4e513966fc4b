"""Pearson correlations of wide tables (A21 beyond a few dozen columns).

Columns are taken in blocks; each pair of blocks is one scan that reads the columns of both only, so up
to ``BLOCK`` columns take one scan. A task adds up, for every cell of the pair, the number of rows in
which both values are present and the moments of both around a shift of its own (the means of its first
batch), as matrix products. It then gives one row a cell: count, means, centred squares and products.
Those rows are merged around the common mean of the cell (Chan, Golub and LeVeque 1979): nothing large
is ever subtracted from something large, however far a column lies from zero. A task holds eight
BLOCK x BLOCK matrices and gives a row a cell, whatever the number of its rows.

Nulls and NaN count as absent, pairwise. A cell with fewer than two rows, or with a column that is
constant in them, has no correlation (null); so has one with an infinite value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.stats import stable
from churnscope.session import ensure_checkpoint_dir

BLOCK = 256
EPS = 1e-15
_CELL = "a int, b int, n long, mx double, my double, xx double, yy double, xy double"


def _moments(n_a: int, same: bool):
    """Arrow batches of the columns of both blocks -> one row a cell."""
    def run(batches):
        shift = sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            there = ~np.isnan(x)
            if shift is None:
                held = there & np.isfinite(x)
                shift = np.where(held, x, 0.0).sum(0) / np.maximum(held.sum(0), 1)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.where(there, x - shift, 0.0)
                m = there.astype(float)
                a, ma, b, mb = (x, m, x, m) if same else (x[:, :n_a], m[:, :n_a], x[:, n_a:], m[:, n_a:])
                new = [ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b]
                sums = new if sums is None else [s + t for s, t in zip(sums, new)]
        if sums is None:
            return
        n, sx, sy, xx, yy, xy = sums
        ia, ib = np.nonzero(n > 0)
        if same:
            ia, ib = ia[ia <= ib], ib[ia <= ib]
        n, sx, sy, xx, yy, xy = (v[ia, ib] for v in (n, sx, sy, xx, yy, xy))
        at = shift if same else shift[:n_a]
        to = shift if same else shift[n_a:]
        with np.errstate(invalid="ignore"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ia, pa.int32()), pa.array(ib, pa.int32()), pa.array(n.astype(np.int64)),
                 pa.array(at[ia] + sx / n), pa.array(to[ib] + sy / n), pa.array(np.maximum(xx - sx * sx / n, 0.0)),
                 pa.array(np.maximum(yy - sy * sy / n, 0.0)), pa.array(xy - sx * sy / n)],
                names=["a", "b", "n", "mx", "my", "xx", "yy", "xy"])
    return run


def co_moments(df: DataFrame, columns, block: int = BLOCK) -> DataFrame:
    """One row for each pair ord_a <= ord_b of ``columns`` that share a row: n, means, centred squares and products."""
    cols, out = list(columns), None
    # positions as names: a column may have any name
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    at = list(range(0, len(cols), block))
    for i in at:
        for j in (x for x in at if x >= i):
            left = [f"c{x}" for x in range(i, min(i + block, len(cols)))]
            right = [] if i == j else [f"c{x}" for x in range(j, min(j + block, len(cols)))]
            part = (d.select(*left, *right).mapInArrow(_moments(len(left), i == j), _CELL)
                    .select((F.col("a") + i).alias("ord_a"), (F.col("b") + j).alias("ord_b"), "n", "mx", "my", "xx", "yy", "xy"))
            out = part if out is None else out.unionByName(part)
    ensure_checkpoint_dir(df.sparkSession)
    cells = out.checkpoint(eager=True)  # a row a task and cell, read twice
    key, n = ["ord_a", "ord_b"], F.col("n")
    mean = cells.groupBy(*key).agg(F.sum("n").alias("_n"), (F.sum(n * F.col("mx")) / F.sum("n")).alias("_mx"),
                                   (F.sum(n * F.col("my")) / F.sum("n")).alias("_my"))
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    return (cells.join(mean, key).groupBy(*key, F.col("_n").alias("count"), F.col("_mx").alias("mean_a"), F.col("_my").alias("mean_b"))
            .agg(F.sum(F.col("xx") + n * dx * dx).alias("ss_a"), F.sum(F.col("yy") + n * dy * dy).alias("ss_b"),
                 F.sum(F.col("xy") + n * dx * dy).alias("ss_ab")))


def correlation_blocks(df: DataFrame, columns, block: int = BLOCK) -> DataFrame:
    """Pearson correlation of every pair of ``columns``, both ways round, long form (var_a, var_b, ord_a, ord_b, r)."""
    cols = list(columns)
    r = F.try_divide(F.col("ss_ab"), F.sqrt("ss_a") * F.sqrt("ss_b"))
    # a deviation below a double's resolution at the mean is a constant's rounding
    varies = lambda ss, mean: F.sqrt(F.col(ss) / F.col("count")) > EPS * F.abs(F.col(mean))
    half = (co_moments(df, cols, block)
            .where((F.col("count") > 1) & varies("ss_a", "mean_a") & varies("ss_b", "mean_b"))
            .select("ord_a", "ord_b", F.when(F.isnan(r), None).when(F.col("ord_a") == F.col("ord_b"), 1.0).otherwise(stable(r)).alias("r")))
    other = half.where("ord_a < ord_b").select(F.col("ord_b").alias("ord_a"), F.col("ord_a").alias("ord_b"), "r")
    names = F.array(*[F.lit(c) for c in cols])
    # every pair has its row, also one without common rows
    pairs = (df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("ord_a"))
             .select("ord_a", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("ord_b")))
    return (pairs.join(half.unionByName(other), ["ord_a", "ord_b"], "left")
            .select(F.get(names, F.col("ord_a")).alias("var_a"), F.get(names, F.col("ord_b")).alias("var_b"), "ord_a", "ord_b", "r"))
