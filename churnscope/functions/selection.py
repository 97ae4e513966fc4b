"""Exact quantiles of very many distinct values: distributed selection by counts of bins.

Input is a histogram (group..., value, n). All wanted ranks of all groups are narrowed down together. The first pass counts
bins that follow the values' order over the whole range of doubles: 64 to each power of two. Every rank keeps the one bin
that holds it, with the bin's smallest and largest value. Each further pass cuts these ranges into 4096 equal parts and
counts only the rows within them, until the range of every rank is one value. A bin of the first pass is at most 1.1 % wide and
each pass divides it by 4096, so five further passes reach neighbouring doubles whatever the distribution; integers
below 90 need none. A task never holds more than its share of counts: at most 4096 a range, or 64 a power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir

#: bins of the first pass to a power of two, and parts of a range in the others
FINE, PARTS = 64, 4096


def coarse_bin(v: Column) -> Column:
    """A bin number that never falls as the value rises; infinities and NaN (the largest) have their own."""
    size = F.floor(F.log2(F.abs(v)) * FINE).cast("long") + 100_000  # above 0 for the smallest double
    return (F.when(F.isnan(v), 1_000_001).when(v == float("inf"), 1_000_000).when(v == float("-inf"), -1_000_000)
            .when(v == 0, 0).when(v > 0, size).otherwise(-size))


def _narrowed(rows: DataFrame, targets: DataFrame, over: list) -> DataFrame:
    """Targets (over..., rank, rest) with the range (lo, hi) of their bin among ``rows`` (over..., bin, value, n), and what is left
    of the rank within it."""
    bins = rows.groupBy(*over, "bin").agg(F.sum("n").alias("c"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    before = Window.partitionBy(*over).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
    found = targets.join(bins, over).where((F.col("rest") >= F.col("below")) & (F.col("rest") < F.col("below") + F.col("c")))
    return found.select("_g", "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("rest") - F.col("below")).alias("rest")).checkpoint(eager=True)


def quantiles(hist: DataFrame, groups: list, probs: list) -> DataFrame:
    """(groups..., q0, q1, ...): the linearly interpolated quantiles of each group with a value that isn't null. ``hist`` is read
    once a pass and should be a written table; groups may be null."""
    ensure_checkpoint_dir(hist.sparkSession)
    h = hist.where(F.col("value").isNotNull()).select(F.struct(*groups).alias("_g"), F.col("value").cast("double").alias("value"), "n")
    total = h.groupBy("_g").agg(F.sum("n").alias("total"))
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    targets = total.select("_g", F.explode(ranks).alias("rank")).withColumn("rest", F.col("rank"))
    found = _narrowed(h.withColumn("bin", coarse_bin(F.col("value"))), targets, ["_g"])
    done = found.where("lo <=> hi")
    while True:
        todo = found.where("NOT lo <=> hi")
        if not todo.head(1):
            break
        ranges = todo.select("_g", "lo", "hi").distinct()
        part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        rows = h.join(ranges, "_g").where("value BETWEEN lo AND hi").withColumn("bin", part)
        found = _narrowed(rows, todo, ["_g", "lo", "hi"])
        done = done.unionByName(found.where("lo <=> hi"))
    values = done.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two ranks a quantile
    out = []
    for i, p in enumerate(place):
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        out.append(F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(f"q{i}"))
    return total.join(values, "_g").select("_g.*", *out)


def modes(hist: DataFrame, groups: list) -> DataFrame:
    """(groups..., mode): the most frequent value that isn't null, the smallest on ties; a partial minimum a task."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))
    return hist.where(F.col("value").isNotNull()).groupBy(*groups).agg(best.getField("v").alias("mode"))
