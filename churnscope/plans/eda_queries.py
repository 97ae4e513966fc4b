"""EDA queries (A4-A22, J1, J5, P11) over ``churn_features`` and ``line_returns``."""

from __future__ import annotations

from churnscope.operators import eda
from churnscope.operators.correlate import correlation_blocks
from churnscope.plans.registry import register
from churnscope.plans.sqltext import bins_case, case_map, lit, long_sql, mode_sql, values_table
from churnscope.sources.fixtures import churn_features, line_category_counts, line_value_histogram, sql_with
from churnscope.spec import AGE_EDGES, AGE_LABELS, CHURN_SPEC, LINE_SPEC, SERVICE_EDGES, SERVICE_LABELS

S = CHURN_SPEC
CF = "churn_features"
LABEL_SQL = "CASE {t} WHEN 0 THEN 'No Churn' WHEN 1 THEN 'Churned' END"


# ---- A4 ---------------------------------------------------------------------------------
@register("target_distribution", sql_with([CF], f"""
SELECT target AS churn, COUNT(*) AS count,
       CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100.0 AS percentage,
       {LABEL_SQL.format(t='target')} AS churn_label
FROM churn_features GROUP BY target"""), ("A4", "A24", "W2"))
def q_target_distribution(spark, sf_dir):
    return eda.target_distribution(churn_features(spark, sf_dir), S)


# ---- A5 ---------------------------------------------------------------------------------
@register("value_frequency", sql_with([CF], """
SELECT services AS value, COUNT(*) AS count,
       CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100.0 AS percentage
FROM churn_features GROUP BY services"""), ("A5", "T2"))
def q_value_frequency(spark, sf_dir):
    return eda.value_frequency(churn_features(spark, sf_dir), "services")


# ---- A6 / A7 ------------------------------------------------------------------------------
def _stats_sql(view: str, cols, by_target: bool) -> str:
    keep = ("target",) if by_target else ()
    g = ["variable", "target"] if by_target else ["variable"]
    gs = ", ".join(g)
    on = " AND ".join(f"l.{c} = m.{c}" for c in g)
    return f"""
WITH long AS ({long_sql(view, cols, keep)}),
modes AS ({mode_sql('long', g)}),
agg AS (
  SELECT {gs}, COUNT(value) AS count, ROUND(AVG(value), 9) AS mean, ROUND(quantile_cont(value, 0.5), 9) AS median,
         ROUND(STDDEV_SAMP(value), 9) AS std, MIN(value) AS min, MAX(value) AS max,
         ROUND(quantile_cont(value, 0.25), 9) AS q1, ROUND(quantile_cont(value, 0.75), 9) AS q3
  FROM long GROUP BY {gs})
SELECT l.*, CAST(m.mode AS DOUBLE) AS mode FROM agg l JOIN modes m ON {on}"""


@register("stats_by_target", sql_with([CF], _stats_sql(CF, S.numeric, True).replace(
    "SELECT l.*,", f"SELECT l.*, {LABEL_SQL.format(t='l.target')} AS target_label,")), ("A6", "A14", "A15", "D1"))
def q_stats_by_target(spark, sf_dir):
    return eda.stats_by_target(churn_features(spark, sf_dir), S)


@register("line_stats_by_target", sql_with(["line_returns"], _stats_sql("line_returns", LINE_SPEC.numeric, True).replace(
    "SELECT l.*,", f"SELECT l.*, {LABEL_SQL.format(t='l.target')} AS target_label,")), ("A6", "A14", "A15"))
def q_line_stats_by_target(spark, sf_dir):
    """A6 over the line-item view from an eagerly aggregated (variable, target, value)
    histogram: the rows are read once and reduced below the supplier join."""
    from pyspark.sql import functions as F
    h = line_value_histogram(spark, sf_dir, LINE_SPEC.numeric, by_target=True)
    return (eda.stats_from_histogram(h)
            .withColumn("target_label", eda.target_label(F.col("target")))
            .orderBy("variable", "target"))


_STAT_ORDER = ("count", "mean", "median", "mode", "std", "min", "max", "q1", "q3")
_STAT_LABELS = ("Count", "Mean", "Median", "Mode", "Std", "Min", "Max", "Q1", "Q3")
_overall_body = _stats_sql(CF, S.numeric, False) + "\n"
_overall_sql = ("WITH w AS (" + _overall_body.strip().replace("\n", "\n  ") + ")\n" + "\nUNION ALL ".join(
    f"SELECT variable, {i} AS stat_ord, {lit(lab)} AS statistic, CAST({n} AS DOUBLE) AS value FROM w"
    for i, (n, lab) in enumerate(zip(_STAT_ORDER, _STAT_LABELS))))


@register("overall_stats", sql_with([CF], _overall_sql), ("A7",))
def q_overall_stats(spark, sf_dir):
    return eda.overall_stats(churn_features(spark, sf_dir), S)


# ---- A8 / J5 / P11 -------------------------------------------------------------------------
def _band_sql(col: str, name: str, edges, labels) -> str:
    dom = values_table([(lab, i) for i, lab in enumerate(labels)], [name, "bin_ord"])
    return f"""
WITH b AS (SELECT {bins_case(col, edges, labels)} AS {name}, target FROM churn_features),
a AS (SELECT {name}, COUNT(*) AS count, AVG(target) AS churn_rate, CAST(SUM(target) AS BIGINT) AS churned_count
      FROM b WHERE {name} IS NOT NULL GROUP BY {name})
SELECT d.{name}, d.bin_ord, CAST(COALESCE(a.count, 0) AS BIGINT) AS count, a.churn_rate,
       CAST(COALESCE(a.churned_count, 0) AS BIGINT) AS churned_count,
       CAST(COALESCE(a.count, 0) - COALESCE(a.churned_count, 0) AS BIGINT) AS no_churn_count
FROM {dom} d LEFT JOIN a ON d.{name} = a.{name}"""


@register("age_band_churn", sql_with([CF], _band_sql("age", "age_group", AGE_EDGES, AGE_LABELS)), ("A8", "J5", "P11"))
def q_age_band_churn(spark, sf_dir):
    return eda.band_churn(churn_features(spark, sf_dir), S, S.age_bins)


@register("service_band", sql_with([CF], _band_sql("services", "services_group", SERVICE_EDGES, SERVICE_LABELS)),
          ("A8", "J5", "P11"))
def q_service_band(spark, sf_dir):
    return eda.band_churn(churn_features(spark, sf_dir), S, S.service_bins)


# ---- A9 / A11 / A12 / A13 / U1 -------------------------------------------------------------------
_CHURN_AGG_SQL = """COUNT(*) AS count, CAST(SUM(target) AS BIGINT) AS churned,
       CAST(SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_churned, AVG(target) AS churn_rate,
       ROUND(STDDEV_POP(target) / SQRT(COUNT(*)), 9) AS std_error, AVG(target) * 100.0 AS churn_rate_pct"""


@register("category_churn", sql_with([CF], f"""
SELECT frequent_buyer AS category, {_CHURN_AGG_SQL}
FROM churn_features GROUP BY frequent_buyer"""), ("A9", "A12", "A13", "D2"))
def q_category_churn(spark, sf_dir):
    return eda.category_churn(churn_features(spark, sf_dir), S, "frequent_buyer")


def _combined_sql(view: str, cols) -> str:
    ords = " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(cols))
    return f"""
WITH long AS ({long_sql(view, cols, ('target',), 'VARCHAR', val='category')})
SELECT variable, category, {_CHURN_AGG_SQL}, CASE variable {ords} END AS var_ord
FROM long GROUP BY variable, category"""


@register("combined_category_churn", sql_with([CF], _combined_sql(CF, S.categorical)), ("A11", "U1", "P4", "P6"))
def q_combined_category_churn(spark, sf_dir):
    return eda.combined_category_churn(churn_features(spark, sf_dir), S)


@register("combined_category_union", sql_with([CF], _combined_sql(CF, S.categorical)), ("U1", "A9"))
def q_combined_category_union(spark, sf_dir):
    return eda.combined_category_churn_union(churn_features(spark, sf_dir), S)


@register("line_category_churn", sql_with(["line_returns"], _combined_sql("line_returns", LINE_SPEC.categorical)),
          ("A11",))
def q_line_category_churn(spark, sf_dir):
    counts = line_category_counts(spark, sf_dir)
    return eda.category_churn_from_counts(counts, LINE_SPEC.categorical)


# ---- A10 ---------------------------------------------------------------------------------------
@register("value_churn", sql_with([CF], """
SELECT services AS value, COUNT(*) AS count, CAST(SUM(target) AS BIGINT) AS churned, AVG(target) AS churn_rate,
       AVG(target) * 100.0 AS churn_rate_pct
FROM churn_features GROUP BY services"""), ("A10",))
def q_value_churn(spark, sf_dir):
    return eda.value_churn(churn_features(spark, sf_dir), S, "services")


# ---- A16 / A17 / P7 / P9 -----------------------------------------------------------------------------
def _fences_sql(view: str, cols, keep=()) -> str:
    return f"""long AS ({long_sql(view, cols, keep)}),
modes AS ({mode_sql('long', ['variable'])}),
f AS (
  SELECT variable, ROUND(quantile_cont(value, 0.25), 9) AS q1, ROUND(quantile_cont(value, 0.75), 9) AS q3,
         COUNT(value) AS n, MIN(value) AS min_value, MAX(value) AS max_value, ROUND(AVG(value), 9) AS mean,
         ROUND(quantile_cont(value, 0.5), 9) AS median
  FROM long GROUP BY variable),
fences AS (
  SELECT f.*, m.mode, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
  FROM f JOIN modes m ON f.variable = m.variable)"""


def _outlier_summary_sql(view: str, cols) -> str:
    return f"""
WITH {_fences_sql(view, cols)},
c AS (SELECT l.variable, CAST(SUM(CASE WHEN l.value < f.lower_fence OR l.value > f.upper_fence THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count
      FROM long l JOIN fences f ON l.variable = f.variable GROUP BY l.variable)
SELECT f.variable, q1, q3, iqr, lower_fence, upper_fence, outlier_count,
       outlier_count / CAST(n AS DOUBLE) * 100.0 AS outlier_percentage, min_value, max_value, mean, median, mode
FROM fences f JOIN c ON f.variable = c.variable"""


@register("outlier_summary", sql_with([CF], _outlier_summary_sql(CF, S.numeric)), ("A16", "A14", "A15"))
def q_outlier_summary(spark, sf_dir):
    return eda.outlier_summary(churn_features(spark, sf_dir), S)


@register("line_outlier_summary", sql_with(["line_returns"], _outlier_summary_sql("line_returns", LINE_SPEC.numeric)),
          ("A16",))
def q_line_outlier_summary(spark, sf_dir):
    return eda.outlier_summary_from_histogram(line_value_histogram(spark, sf_dir, LINE_SPEC.numeric))


@register("outlier_detail", sql_with([CF], f"""
WITH {_fences_sql(CF, S.numeric, ('customer_id', 'target'))}
SELECT l.variable, l.customer_id, l.value, l.target,
       CASE WHEN l.value < f.lower_fence THEN 'Low' ELSE 'High' END AS outlier_type
FROM long l JOIN fences f ON l.variable = f.variable
WHERE l.value < f.lower_fence OR l.value > f.upper_fence"""), ("A17", "P7", "P9"))
def q_outlier_detail(spark, sf_dir):
    return eda.outlier_detail(churn_features(spark, sf_dir), S)


# ---- A18 ---------------------------------------------------------------------------------------------
@register("crosstab_share", sql_with([CF], f"""
WITH long AS ({long_sql(CF, S.categorical, ('target',), 'VARCHAR', val='category')})
SELECT variable, category,
       CAST(SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS share_0,
       CAST(SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS share_1
FROM long GROUP BY variable, category"""), ("A18",))
def q_crosstab_share(spark, sf_dir):
    return eda.crosstab_share(churn_features(spark, sf_dir), S)


# ---- A19 / A20 / J1 ---------------------------------------------------------------------------------
_SG = bins_case("services", SERVICE_EDGES, SERVICE_LABELS)


@register("interaction_rates", sql_with([CF], f"""
WITH b AS (SELECT *, {_SG} AS services_group FROM churn_features)
SELECT 0 AS pair_ord, 'income_class x frequent_buyer' AS interaction, income_class AS first_value,
       frequent_buyer AS second_value, AVG(target) AS churn_rate, COUNT(*) AS count
FROM b GROUP BY income_class, frequent_buyer
UNION ALL
SELECT 1, 'services_group x has_pending', services_group, has_pending, AVG(target), COUNT(*)
FROM b GROUP BY services_group, has_pending"""), ("A19", "A20"))
def q_interaction_rates(spark, sf_dir):
    return eda.interaction_rates(churn_features(spark, sf_dir), S)


@register("interaction_join", sql_with([CF], """
SELECT income_class AS first_value, frequent_buyer AS second_value, AVG(target) AS churn_rate, COUNT(*) AS count
FROM churn_features GROUP BY income_class, frequent_buyer"""), ("J1", "A20"))
def q_interaction_join(spark, sf_dir):
    return eda.interaction_join(churn_features(spark, sf_dir), S, "income_class", "frequent_buyer")


@register("line_interaction_rates", sql_with(["line_returns"], """
SELECT 0 AS pair_ord, 'supplier_region x priority' AS interaction, supplier_region AS first_value,
       priority AS second_value, AVG(target) AS churn_rate, COUNT(*) AS count
FROM line_returns GROUP BY supplier_region, priority"""), ("A19",))
def q_line_interaction_rates(spark, sf_dir):
    # from the eagerly aggregated line counts: the supplier join sees one row per
    # supplier and category pair, not every line item
    from pyspark.sql import functions as F
    counts = line_category_counts(spark, sf_dir)
    a, b = LINE_SPEC.interactions[0]
    return (counts.groupBy(a, b).agg(F.sum("n").alias("count"), F.sum("s").alias("_s"))
            .select(F.lit(0).alias("pair_ord"), F.lit(f"{a} x {b}").alias("interaction"),
                    F.col(a).alias("first_value"), F.col(b).alias("second_value"),
                    (F.col("_s") / F.col("count")).alias("churn_rate"), "count")
            .orderBy("first_value", "second_value"))


# ---- A21 / A22 / A40 / P5 / P8 ----------------------------------------------------------------------------
def _encoded_sql() -> str:
    parts = []
    for name, col, codes in S.corr_columns:
        expr = case_map(col, codes) if codes else col
        parts.append(f"CAST({expr} AS DOUBLE) AS {name}")
    return f"SELECT {', '.join(parts)} FROM churn_features"


def _corr_sql() -> str:
    names = [n for n, _, _ in S.corr_columns]
    aggs = ", ".join(f"ROUND(CORR({a}, {b}), 9) AS c_{min(i, j)}_{max(i, j)}"
                     for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    cells = "\nUNION ALL ".join(
        f"SELECT {lit(a)} AS var_a, {lit(b)} AS var_b, {i} AS ord_a, {j} AS ord_b, c_{min(i, j)}_{max(i, j)} AS r FROM w"
        for i, a in enumerate(names) for j, b in enumerate(names))
    return f"WITH e AS ({_encoded_sql()}),\nw AS (SELECT {aggs} FROM e)\n{cells}"


_CORR = _corr_sql()


@register("encode_maps", sql_with([CF], _encoded_sql()), ("P5", "A21"))
def q_encode_maps(spark, sf_dir):
    return eda.encoded_columns(churn_features(spark, sf_dir), S)


@register("correlation_matrix", sql_with([CF], _CORR), ("A21", "P6"))
def q_correlation_matrix(spark, sf_dir):
    return eda.correlation_matrix(churn_features(spark, sf_dir), S)


@register("correlation_blocks", sql_with([CF], _CORR), ("A21",))
def q_correlation_blocks(spark, sf_dir):
    return correlation_blocks(eda.encoded_columns(churn_features(spark, sf_dir), S), [n for n, _, _ in S.corr_columns])


@register("corr_with_target", sql_with([CF], f"""
WITH m AS ({_CORR.replace(chr(10), ' ')})
SELECT var_a AS variable, r AS correlation FROM m WHERE var_b = 'churn'"""), ("A22", "P8", "T2"))
def q_corr_with_target(spark, sf_dir):
    return eda.corr_with_target(churn_features(spark, sf_dir), S)


@register("corr_lower", sql_with([CF], f"""
WITH m AS ({_CORR.replace(chr(10), ' ')})
SELECT * FROM m WHERE ord_a > ord_b"""), ("A40",))
def q_corr_lower(spark, sf_dir):
    return eda.corr_lower(churn_features(spark, sf_dir), S)


