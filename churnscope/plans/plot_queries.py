"""Chart-data queries (A37-A41, W6) over ``churn_features``."""

from __future__ import annotations

from churnscope.operators import plots
from churnscope.plans.registry import register
from churnscope.plans.sqltext import long_sql
from churnscope.sources.fixtures import churn_features, sql_with
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
CF = "churn_features"
SERVICE_BINS = {"services": (1, 7, 6)}  # bins=range(1, 8) in the reference's services chart

_H = f"""long AS ({long_sql(CF, S.numeric, ('target',))}),
h AS (SELECT variable, target, value, COUNT(*) AS n FROM long GROUP BY variable, target, value)"""


@register("histogram", sql_with([CF], f"""
WITH {_H},
st AS (SELECT variable, COUNT(*) AS nn, MIN(value) AS lo0, MAX(value) AS hi0,
              quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
       FROM long GROUP BY variable),
bw AS (SELECT *, (hi0 - lo0) / (LOG2(nn) + 1.0) AS sturges, 2.0 * (q3 - q1) * POW(nn, -1.0 / 3.0) AS fd FROM st),
lay AS (SELECT variable,
               CASE WHEN variable = 'services' THEN 1.0 WHEN hi0 <= lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN variable = 'services' THEN 7.0 WHEN hi0 <= lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi,
               CASE WHEN variable = 'services' THEN 6 WHEN hi0 <= lo0 THEN 1
                    ELSE CAST(CEIL((hi0 - lo0) / CASE WHEN fd > 0 THEN LEAST(fd, sturges) ELSE sturges END) AS INTEGER) END AS n_bins
        FROM bw),
cnt AS (SELECT h.variable, CAST(LEAST(FLOOR((h.value - l.lo) / (l.hi - l.lo) * l.n_bins), l.n_bins - 1) AS INTEGER) AS bin_ord,
               h.target, SUM(h.n) AS c
        FROM h JOIN lay l ON h.variable = l.variable WHERE h.value >= l.lo AND h.value <= l.hi
        GROUP BY 1, 2, 3),
dom AS (SELECT l.variable, CAST(b.bin_ord AS INTEGER) AS bin_ord, t.target, l.lo, l.hi, l.n_bins
        FROM lay l, LATERAL (SELECT UNNEST(range(0, l.n_bins)) AS bin_ord) b,
             (SELECT DISTINCT variable, target FROM h) t WHERE t.variable = l.variable)
SELECT d.variable, d.bin_ord, ROUND(d.lo + d.bin_ord * ((d.hi - d.lo) / d.n_bins), 9) AS bin_lo,
       ROUND(d.lo + (d.bin_ord + 1) * ((d.hi - d.lo) / d.n_bins), 9) AS bin_hi, d.target,
       CAST(COALESCE(c.c, 0) AS BIGINT) AS count
FROM dom d LEFT JOIN cnt c ON d.variable = c.variable AND d.bin_ord = c.bin_ord AND d.target = c.target"""), ("A37",))
def q_histogram(spark, sf_dir):
    return plots.histogram(churn_features(spark, sf_dir), S, fixed=SERVICE_BINS)


# far more bins than values: nearly all of them are empty
_SPARSE = {"age": (0, 1000, 10_000), "services": (0, 1000, 10_000_000)}


@register("sparse_histogram", sql_with([CF], f"""
WITH {_H},
lay(variable, lo, hi, n_bins) AS (VALUES {", ".join(f"('{v}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({n} AS BIGINT))" for v, (a, b, n) in _SPARSE.items())}),
occ AS (SELECT h.variable, h.target, l.lo, l.hi, l.n_bins, CAST(SUM(h.n) AS BIGINT) AS c,
               CAST(LEAST(FLOOR((h.value - l.lo) / (l.hi - l.lo) * l.n_bins), l.n_bins - 1) AS BIGINT) AS b
        FROM h JOIN lay l ON h.variable = l.variable WHERE h.value >= l.lo AND h.value <= l.hi
        GROUP BY h.variable, h.target, l.lo, l.hi, l.n_bins, b),
gaps AS (SELECT *, COALESCE(LAG(b) OVER w, -1) AS prev, LEAD(b) OVER w IS NULL AS is_last FROM occ
         WINDOW w AS (PARTITION BY variable, target ORDER BY b)),
runs AS (SELECT variable, target, lo, hi, n_bins, b AS bin_ord, CAST(1 AS BIGINT) AS run_length, c AS count FROM gaps
         UNION ALL SELECT variable, target, lo, hi, n_bins, prev + 1, b - prev - 1, 0 FROM gaps WHERE b - prev > 1
         UNION ALL SELECT variable, target, lo, hi, n_bins, b + 1, n_bins - 1 - b, 0 FROM gaps WHERE is_last AND b < n_bins - 1)
SELECT variable, bin_ord, run_length, ROUND(lo + bin_ord * ((hi - lo) / n_bins), 9) AS bin_lo,
       ROUND(lo + (bin_ord + run_length) * ((hi - lo) / n_bins), 9) AS bin_hi, target, CAST(count AS BIGINT) AS count FROM runs"""), ("A37",))
def q_sparse_histogram(spark, sf_dir):
    return plots.sparse_histogram(churn_features(spark, sf_dir), S, fixed=_SPARSE)


@register("density_curve", sql_with([CF], f"""
WITH {_H},
rng AS (SELECT variable, MIN(value) AS g_lo, MAX(value) AS g_hi FROM h GROUP BY variable),
mu AS (SELECT variable, target, SUM(n) AS n_class, SUM(n * value) / SUM(n) AS m FROM h GROUP BY variable, target),
cls AS (SELECT mu.variable, mu.target, mu.n_class, SUM(h.n * (h.value - mu.m) * (h.value - mu.m)) AS ss
        FROM h JOIN mu ON h.variable = mu.variable AND h.target = mu.target
        GROUP BY mu.variable, mu.target, mu.n_class),
bw AS (SELECT c.variable, c.target, c.n_class,
              SQRT(CASE WHEN n_class > 1 THEN ss / (n_class - 1) ELSE 0.0 END) * POW(n_class, -0.2) AS bandwidth, r.g_lo, r.g_hi
       FROM cls c JOIN rng r ON c.variable = r.variable),
g AS (SELECT b.*, CAST(gi.grid_ord AS INTEGER) AS grid_ord, b.g_lo + gi.grid_ord * ((b.g_hi - b.g_lo) / 199.0) AS gx
      FROM bw b, LATERAL (SELECT UNNEST(range(0, 200)) AS grid_ord) gi WHERE b.bandwidth > 0)
SELECT g.variable, g.target, g.grid_ord, ROUND(g.gx, 9) AS grid_x,
       ROUND(SUM(h.n * EXP(-0.5 * ((g.gx - h.value) / g.bandwidth) * ((g.gx - h.value) / g.bandwidth)))
             / (g.n_class * g.bandwidth * SQRT(2 * PI())), 9) AS density
FROM g JOIN h ON g.variable = h.variable AND g.target = h.target
GROUP BY g.variable, g.target, g.grid_ord, g.gx, g.n_class, g.bandwidth"""), ("A38",))
def q_density_curve(spark, sf_dir):
    return plots.density_curve(churn_features(spark, sf_dir), S)


@register("density_binned", sql_with([CF], f"""
WITH {_H},
rng AS (SELECT variable, MIN(value) AS g_lo, MAX(value) AS g_hi FROM long GROUP BY variable),
bw AS (SELECT l.variable, l.target, COUNT(*) AS n_class, COALESCE(STDDEV_SAMP(l.value), 0.0) * POW(COUNT(*), -0.2) AS bandwidth,
              ANY_VALUE(r.g_lo) AS g_lo, ANY_VALUE(r.g_hi) AS g_hi
       FROM long l JOIN rng r ON l.variable = r.variable GROUP BY l.variable, l.target),
pos AS (SELECT h.variable, h.target, h.n, (h.value - b.g_lo) / (b.bandwidth / {plots.FINE}) AS p
        FROM h JOIN bw b ON h.variable = b.variable AND h.target = b.target WHERE b.bandwidth > 0),
lat AS (SELECT variable, target, j, SUM(w) AS w
        FROM (SELECT variable, target, FLOOR(p) AS j, n * (1.0 - (p - FLOOR(p))) AS w FROM pos
              UNION ALL SELECT variable, target, FLOOR(p) + 1, n * (p - FLOOR(p)) FROM pos) GROUP BY variable, target, j),
g AS (SELECT b.*, CAST(gi.grid_ord AS INTEGER) AS grid_ord, b.g_lo + gi.grid_ord * ((b.g_hi - b.g_lo) / 199.0) AS gx
      FROM bw b, LATERAL (SELECT UNNEST(range(0, 200)) AS grid_ord) gi WHERE b.bandwidth > 0)
SELECT g.variable, g.target, g.grid_ord, ROUND(g.gx, 9) AS grid_x,
       ROUND(SUM(l.w * EXP(-0.5 * POW((g.gx - (g.g_lo + l.j * (g.bandwidth / {plots.FINE}))) / g.bandwidth, 2)))
             / (g.n_class * g.bandwidth * SQRT(2 * PI())), 9) AS density
FROM g JOIN lat l ON g.variable = l.variable AND g.target = l.target
GROUP BY g.variable, g.target, g.grid_ord, g.gx, g.n_class, g.bandwidth"""), ("A38",))
def q_density_binned(spark, sf_dir):
    return plots.density_binned(churn_features(spark, sf_dir), S)


@register("boxplot_stats", sql_with([CF], f"""
WITH long AS ({long_sql(CF, S.numeric, ('target',))}),
q AS (SELECT variable, target, ROUND(quantile_cont(value, 0.25), 9) AS q1, ROUND(quantile_cont(value, 0.5), 9) AS median,
             ROUND(quantile_cont(value, 0.75), 9) AS q3 FROM long GROUP BY variable, target),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.variable, f.target, f.q1, f.median, f.q3, f.iqr,
       MIN(CASE WHEN l.value >= f.lf AND l.value <= f.uf THEN l.value END) AS whisker_low,
       MAX(CASE WHEN l.value >= f.lf AND l.value <= f.uf THEN l.value END) AS whisker_high,
       CAST(SUM(CASE WHEN l.value >= f.lf AND l.value <= f.uf THEN 0 ELSE 1 END) AS BIGINT) AS n_fliers
FROM f JOIN long l ON f.variable = l.variable AND f.target = l.target
GROUP BY f.variable, f.target, f.q1, f.median, f.q3, f.iqr"""), ("A39",))
def q_boxplot_stats(spark, sf_dir):
    return plots.boxplot_stats(churn_features(spark, sf_dir), S)


@register("stacked_share", sql_with([CF], f"""
WITH long AS ({long_sql(CF, S.categorical, ('target',), 'VARCHAR', val='category')}),
ct AS (SELECT variable, category,
              CAST(SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS share_0,
              CAST(SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS share_1
       FROM long GROUP BY variable, category),
seg AS (SELECT variable, category, 0 AS target, share_0 AS share FROM ct
        UNION ALL SELECT variable, category, 1, share_1 FROM ct),
b AS (SELECT *, COALESCE(SUM(share) OVER (PARTITION BY variable, category ORDER BY target
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bottom FROM seg)
SELECT variable, category, target, share, bottom, bottom + share / 2 AS label_y, share > 0.05 AS show_label FROM b"""),
          ("A41", "W6"))
def q_stacked_share(spark, sf_dir):
    return plots.stacked_share(churn_features(spark, sf_dir), S)
