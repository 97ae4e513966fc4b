"""Tables behind the reference's charts (A37-A41, W6): histogram counts, density
curves, box-plot numbers and stacked shares. Drawing itself is out of scope.

Every table starts from a per-(variable, class, value) histogram (one grouped pass
with map-side combine), so the cost of the later steps grows with the number of
distinct values, never with rows. Small fitted rows (bin layout, bandwidth, fences)
are broadcast by their group key; grids are generated per row (explode), not joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.selection import quantiles
from churnscope.functions.stats import quantile, stable
from churnscope.operators.eda import crosstab_share, unpivot_columns, value_histogram
from churnscope.session import ensure_checkpoint_dir
from churnscope.spec import OUTLIER_K, RoleSpec

GRID_SIZE = 200


def _hist(df: DataFrame, spec: RoleSpec, columns) -> DataFrame:
    long = unpivot_columns(df, list(columns), [spec.target], "double").where("value IS NOT NULL")
    return long.groupBy("variable", F.col(spec.target).alias("target"), "value").agg(F.count(F.lit(1)).alias("n"))


# ---- A37: histogram -------------------------------------------------------------------------------

def _auto_bins(n: Column, lo: Column, hi: Column, q1: Column, q3: Column) -> Column:
    """numpy's 'auto' bin count: the narrower of the Freedman-Diaconis and Sturges
    widths (Sturges alone when the IQR is 0); one bin for a constant column."""
    span = hi - lo
    sturges = span / (F.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * F.pow(n, F.lit(-1.0 / 3.0))
    bw = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return F.when(span <= 0, F.lit(1)).otherwise(F.ceil(span / bw)).cast("long")


def _layout(df: DataFrame, spec: RoleSpec, cols: list, fixed: dict) -> tuple:
    """The value histogram (written once) and one row a variable: lo, hi, n_bins and its classes."""
    h = _hist(df, spec, cols)
    ensure_checkpoint_dir(df.sparkSession)
    h = h.checkpoint(eager=True)
    stats = h.groupBy("variable").agg(
        F.sum("n").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.array_sort(F.collect_set("target")).alias("_classes"))
    stats = stats.join(quantiles(h, ["variable"], [0.25, 0.75]).withColumnsRenamed({"q0": "_q1", "q1": "_q3"}), "variable", "left")
    lo, hi, nb = F.col("_lo"), F.col("_hi"), _auto_bins(F.col("_n"), F.col("_lo"), F.col("_hi"), F.col("_q1"), F.col("_q3"))
    for v, (flo, fhi, fnb) in fixed.items():
        is_v = F.col("variable") == v
        lo, hi, nb = (F.when(is_v, F.lit(float(flo))).otherwise(lo), F.when(is_v, F.lit(float(fhi))).otherwise(hi),
                      F.when(is_v, F.lit(int(fnb)).cast("long")).otherwise(nb))
    # a constant column gets one bin of width 1 around its value (numpy's rule)
    const = F.col("_hi") <= F.col("_lo")
    return h, stats.select("variable", "_classes", F.when(const, lo - 0.5).otherwise(lo).alias("lo"),
                           F.when(const, hi + 0.5).otherwise(hi).alias("hi"), nb.alias("n_bins"))


def _bin_counts(h: DataFrame, layout: DataFrame) -> DataFrame:
    """Counts of the occupied bins; the layout (one row a variable: bounded) is broadcast to the histogram rows."""
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n_bins")),
                F.col("n_bins") - 1).cast("long")
    return (h.join(F.broadcast(layout.select("variable", "lo", "hi", "n_bins")), "variable")
            .where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
            .groupBy("variable", b.alias("bin_ord"), "target").agg(F.sum("n").alias("count")))


def histogram(df: DataFrame, spec: RoleSpec, columns=None, fixed: dict | None = None) -> DataFrame:
    """Counts per (variable, bin, class) over bins shared by both classes, empty bins
    included. ``fixed`` = {variable: (lo, hi, n_bins)} overrides the automatic layout
    (e.g. services over 1..7 in six unit bins). Bins are [lo, hi) except the last,
    which is closed."""
    h, layout = _layout(df, spec, list(columns or spec.numeric), fixed or {})
    layout = layout.withColumn("n_bins", F.col("n_bins").cast("int"))
    counts = _bin_counts(h, layout).withColumn("bin_ord", F.col("bin_ord").cast("int"))
    domain = (layout.select("variable", "lo", "hi", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin_ord"),
                            "_classes")
              .select("variable", "lo", "hi", "n_bins", "bin_ord", F.explode("_classes").alias("target")))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    return (domain.join(counts, ["variable", "bin_ord", "target"], "left")
            .select("variable", "bin_ord", stable(F.col("lo") + F.col("bin_ord") * width).alias("bin_lo"),
                    stable(F.col("lo") + (F.col("bin_ord") + 1) * width).alias("bin_hi"), "target",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def sparse_histogram(df: DataFrame, spec: RoleSpec, columns=None, fixed: dict | None = None) -> DataFrame:
    """``histogram`` for layouts with far more bins than values: each class's occupied bins, and one row for every
    run of empty bins between, before or after them (``count`` 0, ``run_length`` bins from ``bin_ord`` on). Rows grow
    with the occupied bins, never with the nominal ones; the sum of run_length of a class is the number of bins.
    Counts and bins equal those of ``histogram``."""
    h, layout = _layout(df, spec, list(columns or spec.numeric), fixed or {})
    counts = _bin_counts(h, layout)
    key = ["variable", "target"]
    # the occupied bin before each one: within buckets of 2**16 bins, then over the buckets' last ones
    bucket = F.shiftright("bin_ord", 16)
    inner = Window.partitionBy(*key, "_bucket").orderBy("bin_ord")
    outer = Window.partitionBy(*key).orderBy("_bucket")
    c = counts.withColumn("_bucket", bucket)
    last = (c.groupBy(*key, "_bucket").agg(F.max("bin_ord").alias("_last"))
            .select(*key, "_bucket", F.lag("_last").over(outer).alias("_before"),
                    F.when(F.lead("_bucket").over(outer).isNull(), F.col("_last")).alias("_end")))
    lo_hi = F.broadcast(layout.select("variable", "lo", "hi", "n_bins", "_classes"))  # one row a variable
    first = F.lag("bin_ord").over(inner)
    occ = (c.withColumn("_prev", first).join(last, [*key, "_bucket"])
           .withColumn("_prev", F.coalesce("_prev", "_before", F.lit(-1).cast("long"))).join(lo_hi, "variable"))
    run = lambda at, n, k: F.struct(at.cast("long").alias("bin_ord"), n.cast("long").alias("run_length"), k.cast("long").alias("count"))
    prev, at, n_bins = F.col("_prev"), F.col("bin_ord"), F.col("n_bins")
    runs = F.array_compact(F.array(
        F.when(at - prev > 1, run(prev + 1, at - prev - 1, F.lit(0))), run(at, F.lit(1), F.col("count")),
        F.when((at == F.col("_end")) & (at < n_bins - 1), run(at + 1, n_bins - 1 - at, F.lit(0)))))
    rows = occ.select("variable", "target", "lo", "hi", "n_bins", F.explode(runs).alias("r"))
    # a class none of whose values lies inside the bins is one run
    none = (layout.select("variable", "lo", "hi", "n_bins", F.explode("_classes").alias("target"))
            .join(last.select(*key).distinct(), key, "left_anti")
            .select("variable", "target", "lo", "hi", "n_bins", run(F.lit(0), n_bins, F.lit(0)).alias("r")))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return (rows.unionByName(none)
            .select("variable", "r.bin_ord", "r.run_length", stable(F.col("lo") + F.col("r.bin_ord") * width).alias("bin_lo"),
                    stable(F.col("lo") + (F.col("r.bin_ord") + F.col("r.run_length")) * width).alias("bin_hi"), "target", "r.count"))


# ---- A38: density curve ----------------------------------------------------------------------------

def density_curve(df: DataFrame, spec: RoleSpec, columns=None, grid_size: int = GRID_SIZE) -> DataFrame:
    """Gaussian kernel density of each class on ``grid_size`` points spanning the
    variable's range; Scott bandwidth h = sd(ddof=1) * n^(-1/5) per class. Each
    histogram row emits its kernel value at every grid point (explode), then one
    grouped sum per (variable, class, grid point)."""
    cols = list(columns or spec.numeric)
    h = _hist(df, spec, cols)
    rng = h.groupBy("variable").agg(F.min("value").alias("g_lo"), F.max("value").alias("g_hi"))
    # sample variance in two passes over the (small) histogram: mean first, then the
    # sum of squared deviations (no cancellation for large values)
    means = h.groupBy("variable", "target").agg(F.sum("n").alias("n_class"),
                                                (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("_m"))
    dev = F.col("value") - F.col("_m")
    cls = (h.join(F.broadcast(means), ["variable", "target"])  # one row per (variable, class)
           .groupBy("variable", "target", "n_class")
           .agg(F.sum(F.col("n") * dev * dev).alias("_ss"))
           .withColumn("_var", F.try_divide(F.col("_ss"), F.col("n_class") - 1))
           .withColumn("bandwidth", F.sqrt(F.coalesce(F.col("_var"), F.lit(0.0))) * F.pow(F.col("n_class"), F.lit(-0.2)))
           .join(rng, "variable")
           .select("variable", "target", "n_class", "bandwidth", "g_lo", "g_hi"))
    step = (F.col("g_hi") - F.col("g_lo")) / F.lit(grid_size - 1)
    g = F.col("g_lo") + F.col("grid_ord") * step
    z = (g - F.col("value")) / F.col("bandwidth")
    k = F.col("n") * F.exp(-0.5 * z * z)
    rows = (h.join(F.broadcast(cls), ["variable", "target"])  # one row per (variable, class): bounded
            .where(F.col("bandwidth") > 0)
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid_ord")))
    norm = F.col("n_class") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return (rows.groupBy("variable", "target", "grid_ord", "g_lo", "g_hi", "n_class", "bandwidth")
            .agg(F.sum(k).alias("_k"))
            .select("variable", "target", "grid_ord", stable(g).alias("grid_x"), stable(F.col("_k") / norm).alias("density")))


FINE = 64  # fine bins a bandwidth
REACH = 8.0  # kernel values beyond this many bandwidths (below 6e-15 of the peak) are left out


def density_binned(df: DataFrame, spec: RoleSpec, columns=None, grid_size: int = GRID_SIZE, fine: int = FINE) -> DataFrame:
    """``density_curve`` with constant work a row: every row shares its weight between the two nearest points of a
    lattice of ``fine`` points a bandwidth (linear binning, added up by lattice point before the shuffle), and only
    occupied lattice points spread the kernel, over the grid points within ``REACH`` bandwidths. For any range that is
    at most ``2 * REACH * fine * grid_size`` kernel values a class. The density differs from ``density_curve`` by at
    most 1 / (8 * fine**2 * sqrt(2 pi) * bandwidth): the error of linear interpolation in the kernel."""
    cols = list(columns or spec.numeric)
    long = (unpivot_columns(df, cols, [spec.target], "double").where("value IS NOT NULL").withColumnRenamed(spec.target, "target"))
    v = F.col("value")
    per = long.groupBy("variable", "target").agg(F.count(F.lit(1)).alias("n_class"), F.stddev_samp(v).alias("_sd"),
                                                 F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    ensure_checkpoint_dir(df.sparkSession)
    per = per.checkpoint(eager=True)  # one row a variable and class
    whole = per.groupBy("variable").agg(F.min("_lo").alias("g_lo"), F.max("_hi").alias("g_hi"))
    cls = (per.join(F.broadcast(whole), "variable")
           .withColumn("bandwidth", F.coalesce("_sd", F.lit(0.0)) * F.pow(F.col("n_class"), F.lit(-0.2)))
           .where("bandwidth > 0").select("variable", "target", "n_class", "bandwidth", "g_lo", "g_hi"))
    h, lo = F.col("bandwidth"), F.col("g_lo")
    step, delta = (F.col("g_hi") - lo) / F.lit(grid_size - 1), h / F.lit(fine)
    pos = (v - lo) / delta
    at = F.floor(pos)
    share = pos - at
    points = F.array(F.struct(at.alias("j"), (1.0 - share).alias("w")), F.struct((at + 1).alias("j"), share.alias("w")))
    lattice = (long.join(F.broadcast(cls), ["variable", "target"])
               .select("variable", "target", F.explode(points).alias("p")).groupBy("variable", "target", "p.j").agg(F.sum("p.w").alias("w")))
    x = lo + F.col("j") * delta
    first = F.greatest(F.ceil((x - REACH * h - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((x + REACH * h - lo) / step), F.lit(grid_size - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last))
    z = (lo + F.col("grid_ord") * step - x) / h
    spread = (lattice.where("w > 0").join(F.broadcast(cls), ["variable", "target"]).select("*", F.explode(near).alias("grid_ord"))
              .groupBy("variable", "target", "grid_ord").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("_k")))
    domain = cls.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid_ord"))
    norm = F.col("n_class") * h * math.sqrt(2 * math.pi)
    return (domain.join(spread, ["variable", "target", "grid_ord"], "left")
            .select("variable", "target", "grid_ord", stable(lo + F.col("grid_ord") * step).alias("grid_x"),
                    stable(F.coalesce("_k", F.lit(0.0)) / norm).alias("density")))


# ---- A39: box-plot numbers --------------------------------------------------------------------------

def boxplot_stats(df: DataFrame, spec: RoleSpec, columns=None, approx: bool = False) -> DataFrame:
    """Q1, median, Q3 and whiskers (most extreme values inside the 1.5 IQR fences) per
    variable and class, and the count of points beyond them."""
    cols = list(columns or spec.numeric)
    long = unpivot_columns(df, cols, [spec.target], "double").withColumnRenamed(spec.target, "target")
    v, key = F.col("value"), ["variable", "target"]
    if approx:
        q = long.groupBy(*key).agg(quantile(v, 0.25, True).alias("q1"), quantile(v, 0.5, True).alias("median"), quantile(v, 0.75, True).alias("q3"))
        h = long.withColumn("n", F.lit(1))
    else:
        ensure_checkpoint_dir(df.sparkSession)
        h = value_histogram(long, key).checkpoint(eager=True)
        q = quantiles(h, key, [0.25, 0.5, 0.75]).select(*key, stable(F.col("q0")).alias("q1"), stable(F.col("q1")).alias("median"), stable(F.col("q2")).alias("q3"))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("_lf", F.col("q1") - OUTLIER_K * F.col("iqr"))
         .withColumn("_uf", F.col("q3") + OUTLIER_K * F.col("iqr")))
    inside = (v >= F.col("_lf")) & (v <= F.col("_uf"))
    w = (h.join(F.broadcast(q.select(*key, "_lf", "_uf")), key)  # one row a variable and class
         .groupBy(*key)
         .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
              F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("n_fliers")))
    return q.join(w, key).select(*key, "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "n_fliers")


# ---- A41 / W6: stacked shares ------------------------------------------------------------------------

LABEL_MIN_SHARE = 0.05


def stacked_share(df: DataFrame, spec: RoleSpec, columns=None) -> DataFrame:
    """Segments of the 100 % stacked bars: class share, segment bottom (running sum in
    class order), label position and whether the segment is labelled (> 5 %)."""
    ct = crosstab_share(df, spec, columns)
    seg = ct.select("variable", "category", F.explode(F.array(
        F.struct(F.lit(0).alias("target"), F.col("share_0").alias("share")),
        F.struct(F.lit(1).alias("target"), F.col("share_1").alias("share")))).alias("s")) \
        .select("variable", "category", "s.target", "s.share")
    w = Window.partitionBy("variable", "category").orderBy("target").rowsBetween(Window.unboundedPreceding, -1)
    bottom = F.coalesce(F.sum("share").over(w), F.lit(0.0))
    return (seg.withColumn("bottom", bottom)
            .withColumn("label_y", F.col("bottom") + F.col("share") / 2)
            .withColumn("show_label", F.col("share") > LABEL_MIN_SHARE))


def share_label(share: Column) -> Column:
    """Presentation text of a segment (one decimal, percent)."""
    return F.format_string("%.1f%%", share * 100.0)
