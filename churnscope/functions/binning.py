"""Right-closed binning ``(a, b]`` as column expressions.

Spark's ``Bucketizer`` is left-closed ``[a, b)``; the reference bins with the pandas
convention ``(a, b]`` and leaves values outside every bin empty (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.sources.tables import literal_frame
from churnscope.spec import BinSpec


def right_closed_bin(x: Column, edges, labels) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` holding ``x``; null outside all bins."""
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def bin_ordinal(x: Column, edges) -> Column:
    """0-based index of the bin holding ``x``; null outside all bins."""
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def add_bin(df: DataFrame, spec: BinSpec) -> DataFrame:
    return df.withColumn(spec.name, right_closed_bin(F.col(spec.column), spec.edges, spec.labels))


def bin_domain(spark: SparkSession, spec: BinSpec) -> DataFrame:
    """All bins of a spec, observed or not (a handful of rows fixed by the spec)."""
    return literal_frame(spark, [(label, i) for i, label in enumerate(spec.labels)],
                         [(spec.name, "string"), ("bin_ord", "int")])
