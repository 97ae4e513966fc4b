"""Exploratory tables (distributions, grouped statistics, banded and two-way churn
rates, Tukey fences, correlations).

Every table is one declarative plan: scans prune to the columns used, aggregates run
partial-then-final (map-side combine, so a hot category costs one row per task),
and several columns are handled in one pass by unpivoting them into
``(variable, value)`` rows instead of one scan per column. Small fitted results that
feed a second step (fences, per-variable bounds) are a handful of rows, broadcast.

Values are returned unrounded, except statistics whose last bits depend on the
summation order (std, correlation, interpolated quantiles, means of doubles), which are
rounded to 9 digits so results do not depend on partitioning; ``present`` applies the
reference's table rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.binning import add_bin, bin_domain, bin_ordinal, right_closed_bin
from churnscope.functions.selection import quantiles
from churnscope.functions.stats import count_where, mode_lowest, quantile, share_pct, stable, std_error_pop
from churnscope.session import ensure_checkpoint_dir
from churnscope.sources.tables import require_columns
from churnscope.spec import OUTLIER_K, TARGET_LABELS, BinSpec, RoleSpec


def target_label(t: Column) -> Column:
    return F.when(t == 0, TARGET_LABELS[0]).when(t == 1, TARGET_LABELS[1])


def _grand_total(agg: DataFrame, col: str = "count") -> Column:
    """The table's total as a scalar subquery (one value, broadcast by Spark), so a
    share never needs a window that pulls every group into one task."""
    return agg.select(F.sum(col)).scalar()


def present(df: DataFrame, digits: dict) -> DataFrame:
    """Round selected columns half-to-even, as the reference's tables are. As there, a
    rate in percent is derived from the already rounded rate."""
    out = df.select(*[F.bround(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
    if "churn_rate_pct" in digits and "churn_rate" in digits:
        out = out.withColumn("churn_rate_pct", F.bround(F.col("churn_rate") * 100.0, digits["churn_rate_pct"]))
    return out


def unpivot_columns(df: DataFrame, columns, keep, value_type: str | None = None,
                    var: str = "variable", val: str = "value") -> DataFrame:
    """Long form: one row per input row and listed column (a generator, no join)."""
    require_columns(df, list(columns) + list(keep), "input table")
    vals = [F.col(c) if value_type is None else F.col(c).cast(value_type) for c in columns]
    items = F.array(*[F.struct(F.lit(c).alias(var), v.alias(val)) for c, v in zip(columns, vals)])
    return df.select(*keep, F.explode(items).alias("_u")).select(*keep, f"_u.{var}", f"_u.{val}")


# --- A4 / A5 / A24: frequency tables -------------------------------------------------

def target_distribution(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Count and share of each target value, most frequent first (value_counts)."""
    t = spec.target
    agg = df.groupBy(F.col(t).alias("churn")).agg(F.count(F.lit(1)).alias("count"))
    return (agg.withColumn("percentage", share_pct(F.col("count"), _grand_total(agg)))
            .withColumn("churn_label", target_label(F.col("churn")))
            .orderBy(F.desc("count"), "churn"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, in value order (value_counts().sort_index())."""
    agg = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return (agg.withColumn("percentage", share_pct(F.col("count"), _grand_total(agg)))
            .orderBy("value"))


# --- A6 / A7: numeric statistics ----------------------------------------------------------

def _numeric_aggs(v: Column, approx: bool = False) -> list:
    return [
        F.count(v).alias("count"),
        stable(F.avg(v)).alias("mean"),
        quantile(v, 0.5, approx).alias("median"),
        mode_lowest(v).cast("double").alias("mode"),
        stable(F.stddev_samp(v)).alias("std"),
        F.min(v).cast("double").alias("min"),
        F.max(v).cast("double").alias("max"),
        quantile(v, 0.25, approx).alias("q1"),
        quantile(v, 0.75, approx).alias("q3"),
    ]


STAT_NAMES = ("count", "mean", "median", "mode", "std", "min", "max", "q1", "q3")
STAT_LABELS = ("Count", "Mean", "Median", "Mode", "Std", "Min", "Max", "Q1", "Q3")


def stats_by_target(df: DataFrame, spec: RoleSpec, columns=None, approx: bool = False) -> DataFrame:
    """count, mean, median, mode, sample std, min, max, Q1, Q3 per numeric column and
    target value; all columns in one scan."""
    cols = list(columns or spec.numeric)
    long = unpivot_columns(df, cols, [spec.target], "double").withColumnRenamed(spec.target, "target")
    stats = (long.groupBy("variable", "target").agg(*_numeric_aggs(F.col("value"), approx)) if approx
             else stats_from_histogram(value_histogram(long, ("variable", "target"))))
    return (stats.withColumn("target_label", target_label(F.col("target")))
            .orderBy("variable", "target"))


def _same_group(gc: list):
    """Join condition of two tables ``a`` and ``b`` on group columns that may be null."""
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in gc]


def stats_from_histogram(h: DataFrame, group_cols=("variable", "target")) -> DataFrame:
    """The nine statistics of ``stats_by_target`` from a (group..., value, n) histogram, which is written once:
    exact quantiles by selection (no map of all values in one task), mode (lowest on ties), and the sample
    standard deviation in two passes over the histogram (mean first, then squared deviations)."""
    gc = list(group_cols)
    ensure_checkpoint_dir(h.sparkSession)
    h = h.checkpoint(eager=True)
    v, n = F.col("value"), F.col("n")
    # nulls count in no statistic, as in the exact path
    known = F.sum(F.when(v.isNotNull(), n))
    base = h.groupBy(*gc).agg(
        F.coalesce(known, F.lit(0)).alias("count"), F.try_divide(F.sum(v * n), known).alias("_m"),
        F.min(F.when(v.isNotNull(), F.struct((-n).alias("_neg_n"), v.alias("_v")))).getField("_v").cast("double").alias("mode"),
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    dev = F.col("value") - F.col("_m")
    means = base.select(*gc, "_m").alias("b")
    ss = (h.alias("a").join(F.broadcast(means), _same_group(gc))  # one row per group: bounded
          .groupBy(*[F.col(f"a.{c}").alias(c) for c in gc]).agg(F.sum(F.col("n") * dev * dev).alias("_ss")))
    qs = quantiles(h, gc, [0.25, 0.5, 0.75])
    own = [F.col(f"a.{c}").alias(c) for c in gc]
    full = base.alias("a").join(ss.alias("b"), _same_group(gc)).select(*own, "count", "_m", "mode", "min", "max", "_ss")
    full = full.alias("a").join(qs.alias("b"), _same_group(gc), "left").select(*own, "count", "_m", "mode", "min", "max", "_ss", "q0", "q1", "q2")
    return full.select(*gc, "count", stable(F.col("_m")).alias("mean"), stable(F.col("q1")).alias("median"), "mode",
                       stable(F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1))).alias("std"),
                       "min", "max", stable(F.col("q0")).alias("q1"), stable(F.col("q2")).alias("q3"))


def overall_stats(df: DataFrame, spec: RoleSpec, columns=None, approx: bool = False) -> DataFrame:
    """The same nine statistics over the whole table, long form (variable, statistic, value)."""
    cols = list(columns or spec.numeric)
    long = unpivot_columns(df, cols, [], "double")
    wide = (long.groupBy("variable").agg(*_numeric_aggs(F.col("value"), approx)) if approx
            else stats_from_histogram(value_histogram(long), ("variable",)))
    items = F.array(*[F.struct(F.lit(i).alias("stat_ord"), F.lit(lab).alias("statistic"),
                               F.col(n).cast("double").alias("value"))
                     for i, (n, lab) in enumerate(zip(STAT_NAMES, STAT_LABELS))])
    return (wide.select("variable", F.explode(items).alias("s"))
            .select("variable", "s.stat_ord", "s.statistic", "s.value")
            .orderBy("variable", "stat_ord"))


# --- A8 / J5: banded churn with empty bands ---------------------------------------------

def band_churn(df: DataFrame, spec: RoleSpec, bins: BinSpec) -> DataFrame:
    """Count, churn rate, churned and not-churned per right-closed band; bands with no
    rows are kept with count 0 and a null rate (outer join with the band domain)."""
    t = F.col(spec.target)
    band = right_closed_bin(F.col(bins.column), bins.edges, bins.labels)
    agg = (df.select(band.alias(bins.name), t.alias("_t"))
           .where(F.col(bins.name).isNotNull())
           .groupBy(bins.name)
           .agg(F.count(F.lit(1)).alias("count"), F.avg("_t").alias("churn_rate"),
                F.sum("_t").cast("long").alias("churned_count")))
    dom = bin_domain(df.sparkSession, bins)
    return (F.broadcast(dom).join(agg, bins.name, "left")
            .select(bins.name, "bin_ord",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    "churn_rate",
                    F.coalesce(F.col("churned_count"), F.lit(0)).cast("long").alias("churned_count"))
            .withColumn("no_churn_count", F.col("count") - F.col("churned_count"))
            .orderBy("bin_ord"))


# --- A9 / A10 / A11 / A12 / A13: categorical churn ------------------------------------------

def _churn_aggs(t: Column) -> list:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum(t).cast("long").alias("churned"),
        count_where(t == 0).alias("not_churned"),
        F.avg(t).alias("churn_rate"),
        stable(std_error_pop(t)).alias("std_error"),
    ]


def category_churn(df: DataFrame, spec: RoleSpec, column: str) -> DataFrame:
    """Count, churned, not churned, rate, standard error and rate % per category."""
    t = F.col(spec.target)
    return (df.groupBy(F.col(column).alias("category")).agg(*_churn_aggs(t))
            .withColumn("churn_rate_pct", F.col("churn_rate") * 100.0)
            .orderBy("category"))


def combined_category_churn(df: DataFrame, spec: RoleSpec, columns=None) -> DataFrame:
    """A9 for every categorical column in one scan: unpivot to (variable, category)
    and group once, instead of one pass per column."""
    cols = list(columns or spec.categorical)
    order = {c: i for i, c in enumerate(cols)}
    long = unpivot_columns(df, cols, [spec.target], "string", val="category")
    var_ord = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    return (long.groupBy("variable", "category").agg(*_churn_aggs(F.col(spec.target)))
            .withColumn("churn_rate_pct", F.col("churn_rate") * 100.0)
            .withColumn("var_ord", var_ord[F.col("variable")])
            .orderBy("var_ord", "category"))


def combined_category_churn_union(df: DataFrame, spec: RoleSpec, columns=None) -> DataFrame:
    """The reference's shape of A11 (one aggregate per column, then union-all); kept
    as the cross-check of ``combined_category_churn``."""
    cols = list(columns or spec.categorical)
    parts = [category_churn(df, spec, c).withColumn("variable", F.lit(c)).withColumn("var_ord", F.lit(i))
             for i, c in enumerate(cols)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("var_ord", "category")


def category_churn_from_counts(counts: DataFrame, columns, n: str = "n", s: str = "s", s2: str = "s2",
                               z: str = "z") -> DataFrame:
    """A11 from pre-aggregated rows ``(categories..., n, s, s2, z)`` with n = rows,
    s = sum(target), s2 = sum(target^2), z = rows with target 0. Lets a caller reduce a
    fact table by its join keys before joining dimensions (eager aggregation); counts
    and sums are decomposable, so the result equals aggregating the joined rows."""
    cols = list(columns)
    order = {c: i for i, c in enumerate(cols)}
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in cols])
    long = counts.select(F.explode(items).alias("_u"), n, s, s2, z).select("_u.variable", "_u.category", n, s, s2, z)
    agg = long.groupBy("variable", "category").agg(
        F.sum(n).cast("long").alias("count"), F.sum(s).cast("long").alias("churned"),
        F.sum(z).cast("long").alias("not_churned"), F.sum(s).alias("_s"), F.sum(s2).alias("_s2"))
    mean = F.col("_s") / F.col("count")
    var = F.greatest(F.col("_s2") / F.col("count") - mean * mean, F.lit(0.0))
    var_ord = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    return (agg.select("variable", "category", "count", "churned", "not_churned", mean.alias("churn_rate"),
                       stable(F.sqrt(var) / F.sqrt(F.col("count"))).alias("std_error"))
            .withColumn("churn_rate_pct", F.col("churn_rate") * 100.0)
            .withColumn("var_ord", var_ord[F.col("variable")])
            .orderBy("var_ord", "category"))


def value_churn(df: DataFrame, spec: RoleSpec, column: str) -> DataFrame:
    """Count, churned, rate and rate % per integer value."""
    t = F.col(spec.target)
    return (df.groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum(t).cast("long").alias("churned"), F.avg(t).alias("churn_rate"))
            .withColumn("churn_rate_pct", F.col("churn_rate") * 100.0)
            .orderBy("value"))


# --- A16 / A17: Tukey fences -----------------------------------------------------------------

def value_histogram(long: DataFrame, group_cols=("variable",)) -> DataFrame:
    """(group..., value, n): one pass over the rows with map-side combine; its size is
    the number of distinct values, whatever the row count or skew."""
    return long.groupBy(*group_cols, "value").agg(F.count(F.lit(1)).alias("n"))


def _fences_from_hist(h: DataFrame) -> DataFrame:
    """Tukey fences and summary statistics per variable from the written value histogram
    (exact quantiles by selection; mode = most frequent, lowest on ties)."""
    v, n = F.col("value"), F.col("n")
    base = h.groupBy("variable").agg(
        F.sum(n).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        # nulls count in no statistic; the outlier share is one of all rows
        stable(F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n)))).alias("mean"),
        F.min(F.when(v.isNotNull(), F.struct((-n).alias("_neg_n"), v.alias("_v")))).getField("_v").alias("mode"))
    qs = quantiles(h, ["variable"], [0.25, 0.5, 0.75])
    return (base.join(qs, "variable", "left")
            .withColumns({"median": stable(F.col("q1")), "q1": stable(F.col("q0")), "q3": stable(F.col("q2"))}).drop("q0", "q2")
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - OUTLIER_K * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + OUTLIER_K * F.col("iqr")))


def _fences(long: DataFrame, approx: bool = False) -> DataFrame:
    v = F.col("value")
    if not approx:
        ensure_checkpoint_dir(long.sparkSession)
        return _fences_from_hist(value_histogram(long).checkpoint(eager=True))
    return (long.groupBy("variable")
            .agg(quantile(v, 0.25, approx).alias("q1"), quantile(v, 0.75, approx).alias("q3"),
                 F.count(F.lit(1)).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
                 stable(F.avg(v)).alias("mean"), quantile(v, 0.5, approx).alias("median"), mode_lowest(v).alias("mode"))
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - OUTLIER_K * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + OUTLIER_K * F.col("iqr")))


def outlier_summary_from_histogram(h: DataFrame) -> DataFrame:
    """A16 from a (variable, value, n) histogram built by the caller (e.g. eagerly
    aggregated below a join)."""
    ensure_checkpoint_dir(h.sparkSession)
    h = h.checkpoint(eager=True)
    fences = _fences_from_hist(h)
    outside = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    counts = (h.join(F.broadcast(fences.select("variable", "lower_fence", "upper_fence")), "variable")
              .groupBy("variable").agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).cast("long")
                                       .alias("outlier_count")))
    return (fences.join(counts, "variable")
            .withColumn("outlier_percentage", F.col("outlier_count") / F.col("n") * 100.0)
            .select("variable", "q1", "q3", "iqr", "lower_fence", "upper_fence", "outlier_count",
                    "outlier_percentage", "min_value", "max_value", "mean", "median", "mode")
            .orderBy("variable"))


def outlier_summary(df: DataFrame, spec: RoleSpec, columns=None, approx: bool = False) -> DataFrame:
    """Q1, Q3, IQR, fences, outlier count and %, min, max, mean, median, mode per
    numeric column. The rows are read once, into a per-variable value histogram; the
    fences (one row per variable) and the outlier counts come from the histogram."""
    cols = list(columns or spec.numeric)
    long = unpivot_columns(df, cols, [], "double")
    outside = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    if approx:
        fences = _fences(long, approx)
        counts = (long.join(F.broadcast(fences.select("variable", "lower_fence", "upper_fence")), "variable")
                  .groupBy("variable").agg(count_where(outside).alias("outlier_count")))
    else:
        return outlier_summary_from_histogram(value_histogram(long))
    return (fences.join(counts, "variable")
            .withColumn("outlier_percentage", F.col("outlier_count") / F.col("n") * 100.0)
            .select("variable", "q1", "q3", "iqr", "lower_fence", "upper_fence", "outlier_count",
                    "outlier_percentage", "min_value", "max_value", "mean", "median", "mode")
            .orderBy("variable"))


def outlier_detail(df: DataFrame, spec: RoleSpec, columns=None, approx: bool = False) -> DataFrame:
    """Rows outside the fences with their target and 'Low'/'High' label."""
    cols = list(columns or spec.numeric)
    long = unpivot_columns(df, cols, [spec.key, spec.target], "double")
    fences = _fences(long, approx).select("variable", "lower_fence", "upper_fence")
    v = F.col("value")
    return (long.join(F.broadcast(fences), "variable")
            .where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
            .select("variable", spec.key, "value", F.col(spec.target).alias("target"),
                    F.when(v < F.col("lower_fence"), "Low").otherwise("High").alias("outlier_type")))


# --- A18 / A19 / A20 / J1: crosstabs and interactions ---------------------------------------

def crosstab_share(df: DataFrame, spec: RoleSpec, columns=None) -> DataFrame:
    """Row-normalised crosstab category x target (share of 0 and of 1), all columns in one scan."""
    cols = list(columns or spec.categorical)
    long = unpivot_columns(df, cols, [spec.target], "string", val="category")
    t = F.col(spec.target)
    n = F.count(F.lit(1))
    return (long.groupBy("variable", "category")
            .agg((count_where(t == 0) / n).alias("share_0"), (count_where(t == 1) / n).alias("share_1"))
            .orderBy("variable", "category"))


def _with_service_band(df: DataFrame, spec: RoleSpec) -> DataFrame:
    if spec.service_bins is not None and spec.service_bins.name not in df.columns:
        df = add_bin(df, spec.service_bins)
    return df


def interaction_rates(df: DataFrame, spec: RoleSpec, pairs=None) -> DataFrame:
    """Churn rate and size of every observed combination of each pair, all pairs in
    one scan (grouping sets); replaces crosstab + size + merge."""
    pairs = list(pairs or spec.interactions)
    df = _with_service_band(df, spec)
    cols = sorted({c for p in pairs for c in p})
    sets = [[F.col(a), F.col(b)] for a, b in pairs]
    t = F.col(spec.target)
    g = (df.groupingSets(sets, *[F.col(c) for c in cols])
         .agg(F.avg(t).alias("churn_rate"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")))
    # grouping_id bit i (from the left, over ``cols``) is 1 when cols[i] is aggregated away
    nbits = len(cols)
    outs = []
    for i, (a, b) in enumerate(pairs):
        gid = sum(1 << (nbits - 1 - j) for j, c in enumerate(cols) if c not in (a, b))
        outs.append(F.when(F.col("_gid") == gid, F.struct(F.lit(i).alias("pair_ord"), F.lit(f"{a} x {b}").alias("interaction"),
                                                          F.col(a).cast("string").alias("first_value"),
                                                          F.col(b).cast("string").alias("second_value"))))
    pick = F.coalesce(*outs)
    return (g.select(pick.alias("p"), "churn_rate", "count")
            .select("p.pair_ord", "p.interaction", "p.first_value", "p.second_value", "churn_rate", "count")
            .orderBy("pair_ord", "first_value", "second_value"))


def interaction_join(df: DataFrame, spec: RoleSpec, a: str, b: str) -> DataFrame:
    """The reference's two-step form: rates and counts as two aggregates joined on both
    keys (inner equi-join). Equal to ``interaction_rates`` for one pair."""
    df = _with_service_band(df, spec)
    t = F.col(spec.target)
    rates = df.groupBy(a, b).agg(F.avg(t).alias("churn_rate"))
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    return (rates.join(counts, [a, b], "inner")
            .select(F.col(a).cast("string").alias("first_value"), F.col(b).cast("string").alias("second_value"),
                    "churn_rate", "count")
            .orderBy("first_value", "second_value"))


# --- A21 / A22 / A40: correlations --------------------------------------------------------------

def encoded_columns(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Numeric columns as they are; categorical ones through their fixed code map
    (values without a code become null)."""
    sel = []
    for name, col, codes in spec.corr_columns:
        c = F.col(col)
        if codes:
            m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
            c = m[c]
        sel.append(c.cast("double").alias(name))
    return df.select(*sel)


def correlation_matrix(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Pearson correlation of every pair of encoded columns, long form
    (var_a, var_b, ord_a, ord_b, r); all pairs in one aggregate over one scan."""
    enc = encoded_columns(df, spec)
    names = [n for n, _, _ in spec.corr_columns]
    # covariance over the product of deviations, all three over the rows where both
    # values are present (pairwise, as pandas and SQL CORR); try_divide gives null (not an
    # ANSI division error) when a column is constant
    def pearson(a, b):
        x = F.when(F.col(b).isNotNull(), F.col(a))
        y = F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    # the diagonal is 1 for any column that varies (null for a constant one)
    aggs = [(stable(pearson(a, b)) if i < j else F.when(F.stddev_pop(a) > 0, F.lit(1.0))).alias(f"{i}_{j}")
            for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    wide = enc.agg(*aggs)
    items = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            key = f"{min(i, j)}_{max(i, j)}"
            items.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.lit(i).alias("ord_a"),
                                  F.lit(j).alias("ord_b"), F.col(key).alias("r")))
    return (wide.select(F.explode(F.array(*items)).alias("c"))
            .select("c.var_a", "c.var_b", "c.ord_a", "c.ord_b", "c.r")
            .orderBy("ord_a", "ord_b"))


def corr_with_target(df: DataFrame, spec: RoleSpec, matrix: DataFrame | None = None) -> DataFrame:
    """Correlation of every encoded column with the target, strongest positive first."""
    m = matrix if matrix is not None else correlation_matrix(df, spec)
    return (m.where(F.col("var_b") == spec.target_display)
            .select(F.col("var_a").alias("variable"), F.col("r").alias("correlation"))
            .orderBy(F.desc("correlation"), "variable"))


def corr_lower(df: DataFrame, spec: RoleSpec, matrix: DataFrame | None = None) -> DataFrame:
    """Cells below the diagonal (the half a masked heatmap shows)."""
    m = matrix if matrix is not None else correlation_matrix(df, spec)
    return m.where(F.col("ord_a") > F.col("ord_b"))


__all__ = [
    "present", "unpivot_columns", "target_distribution", "value_frequency", "stats_by_target", "overall_stats",
    "band_churn", "category_churn", "combined_category_churn", "combined_category_churn_union", "value_churn",
    "outlier_summary", "outlier_detail", "crosstab_share", "interaction_rates", "interaction_join",
    "encoded_columns", "correlation_matrix", "corr_with_target", "corr_lower", "bin_ordinal",
]
