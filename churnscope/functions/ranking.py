"""Exact ranks and running sums that never hold a whole group in one task.

A window ``partitionBy(g).orderBy(v)`` moves every row of group ``g`` into one task;
with a binary target one group is half the table, and a hot key can be a third of
it. Here the order value is first cut into range buckets whose bounds come from an
approximate-quantile sketch (one small row per group). Per-bucket totals (groups x
buckets rows, bounded) give each bucket its offset; the rank or running sum inside a
bucket is an ordinary window over that bucket only. Result = offset + local value,
exact because buckets are contiguous ranges of the order value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BOUNDS = "_rk_bounds"
_BUCKET = "_rk_bucket"


def _with_buckets(df: DataFrame, pc: list, order_col: str, n_buckets: int) -> DataFrame:
    """Add a bucket id that is monotone in ``order_col`` within each partition group.

    Bucket bounds are 2^k - 1 approximate quantiles of the order column per group (2^k
    = ``n_buckets`` rounded up to a power of two): one small row per group, broadcast
    by the group key (or, with no group, a scalar subquery). Each row finds its bucket
    by binary search over the bounds: k compare-and-step projections (code-generated
    column expressions), so the cost per row grows with log of the bucket count."""
    k = max(0, math.ceil(math.log2(max(1, int(n_buckets)))))
    if k == 0:
        return df.withColumn(_BUCKET, F.lit(0))
    nb = 2 ** k
    probs = [i / nb for i in range(1, nb)]
    v = F.col(order_col).cast("double")
    sketch = F.percentile_approx(v, probs, 10000).alias(_BOUNDS)
    if pc:
        b = df.join(F.broadcast(df.groupBy(*pc).agg(sketch)), pc)
    else:
        b = df.withColumn(_BOUNDS, df.agg(sketch).scalar())
    # bucket = number of bounds below the value; bounds are sorted
    b = b.withColumn(_BUCKET, F.lit(0))
    half = nb // 2
    while half >= 1:
        step = F.col(_BUCKET) + F.lit(half)
        b = b.withColumn(_BUCKET, F.when(F.element_at(F.col(_BOUNDS), step) < v, step).otherwise(F.col(_BUCKET)))
        half //= 2
    return b.drop(_BOUNDS)


def _offset_window(pc: list):
    # over per-bucket totals: groups x buckets rows, bounded by the bucket count
    w = Window.partitionBy(*pc) if pc else Window.partitionBy()
    return w.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def global_row_number(df: DataFrame, partition_cols, order_cols, n_buckets: int, out: str = "rank") -> DataFrame:
    """1-based row number within ``partition_cols`` ordered by ``order_cols`` (the first
    one decides the bucket; later ones only break ties)."""
    pc = list(partition_cols)
    order_cols = list(order_cols)
    b = _with_buckets(df, pc, order_cols[0], n_buckets)
    counts = b.groupBy(*pc, _BUCKET).agg(F.count(F.lit(1)).alias("_rk_n"))
    offsets = counts.select(*pc, _BUCKET, F.coalesce(F.sum("_rk_n").over(_offset_window(pc)), F.lit(0)).alias("_rk_off"))
    w_loc = Window.partitionBy(*pc, _BUCKET).orderBy(*order_cols)
    return (b.join(F.broadcast(offsets), pc + [_BUCKET])
            .withColumn(out, F.col("_rk_off") + F.row_number().over(w_loc))
            .drop("_rk_off", _BUCKET))


def exclusive_running_sum(df: DataFrame, partition_cols, order_col, sum_cols, n_buckets: int,
                          suffix: str = "_before") -> DataFrame:
    """For each row, the sum of ``sum_cols`` over rows of its group that come earlier in
    ``order_col`` (a column or a list: the first decides the bucket, later ones break
    ties). The order must be a total order within a group (aggregate first)."""
    pc = list(partition_cols)
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    order_col = order_cols[0]
    b = _with_buckets(df, pc, order_col, n_buckets)
    tot = b.groupBy(*pc, _BUCKET).agg(*[F.sum(c).alias(f"_rk_t_{c}") for c in sum_cols])
    offsets = tot.select(*pc, _BUCKET, *[F.coalesce(F.sum(f"_rk_t_{c}").over(_offset_window(pc)), F.lit(0))
                                         .alias(f"_rk_o_{c}") for c in sum_cols])
    w_loc = Window.partitionBy(*pc, _BUCKET).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    res = b.join(F.broadcast(offsets), pc + [_BUCKET])
    for c in sum_cols:
        res = res.withColumn(c + suffix, F.col(f"_rk_o_{c}") + F.coalesce(F.sum(c).over(w_loc), F.lit(0)))
    return res.drop(_BUCKET, *[f"_rk_o_{c}" for c in sum_cols])
