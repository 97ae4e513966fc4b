"""Aggregate expressions used across the operators.

Exact ``percentile``/``median``/``mode`` keep a value -> count map per group and merge
partial maps across tasks: cheap for the small integer domains of churn tables. For
continuous columns at scale pass ``approx=True`` (``percentile_approx``: a bounded
sketch per group).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits kept for statistics whose last bits depend on summation order (std, corr,
# interpolated quantiles). Presentation rounding of the reference's tables is a
# separate, explicit step (``present``).
STAT_DIGITS = 9


def stable(c: Column) -> Column:
    return F.round(c, STAT_DIGITS)


def quantile(x: Column, q: float, approx: bool = False) -> Column:
    if approx:
        return F.percentile_approx(x, q, 10000).cast("double")
    # linear interpolation between neighbours; last bits vary by engine
    return stable(F.percentile(x, F.lit(q)).cast("double"))


def median(x: Column, approx: bool = False) -> Column:
    return quantile(x, 0.5, approx)


def mode_lowest(x: Column) -> Column:
    """Most frequent value; ties go to the smallest value (scipy ``stats.mode``)."""
    return F.mode(x, True)


def std_error_pop(x: Column) -> Column:
    """Population standard deviation over sqrt(n) (numpy ``std`` default)."""
    return F.stddev_pop(x) / F.sqrt(F.count(x))


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def share_pct(count: Column, total: Column) -> Column:
    return count.cast("double") / total * 100.0
