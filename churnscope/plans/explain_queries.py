"""Attribution queries (X1, X6-X12, A31-A33, T3, T4, J2, J3) over ``attributions``."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions import texts as TX
from churnscope.functions.stats import stable
from churnscope.operators import explain as ex
from churnscope.operators.prepare import distinct_values
from churnscope.plans.registry import register
from churnscope.plans.sqltext import case_map, lit, long_sql
from churnscope.sources.fixtures import ATTRIBUTION_WEIGHTS, attribution_rows, attribution_terms, attributions, churn_features, sql_with
from churnscope.sources.tables import literal_frame
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
V = ["attributions"]


# ---- shared Spark pieces ----------------------------------------------------------------------

def feature_meta(spark, sf_dir, cf=None):
    """Feature metadata from the category values of churn_features (bounded, checked)."""
    cf = cf if cf is not None else churn_features(spark, sf_dir)
    return ex.feature_metadata(spark, S, distinct_values(cf, list(S.categorical)))


def factor_frame(spark, sf_dir, cf=None):
    """One row per customer with its contributions and factor list."""
    cf = cf if cf is not None else churn_features(spark, sf_dir)
    return ex.factor_lists(attribution_rows(spark, sf_dir, cf), feature_meta(spark, sf_dir, cf))


# ---- shared SQL pieces --------------------------------------------------------------------------

def _display_sql(built: str) -> str:
    """The fixed display name of an encoded column unless its '(vs X)' names a category
    value of the variable other than the reference; else the built name."""
    from churnscope.operators.explain import _vs_value
    by_analog = {S.analog.get(c, c): c for c in S.categorical}
    whens = []
    for key, text in TX.DISPLAY_FEATURE.items():
        var_a, value = key.split("_", 1)
        if var_a not in by_analog:
            continue
        var = by_analog[var_a]
        cond = f"variable = {lit(var)} AND value = {lit(value)}"
        vs = _vs_value(text)
        if vs is not None:
            cond += (f" AND (ref = {lit(vs)} OR NOT EXISTS (SELECT 1 FROM cats c2 WHERE c2.variable = {lit(var)} "
                     f"AND c2.value = {lit(vs)}))")
        whens.append(f"WHEN {cond} THEN {lit(text)}")
    return f"CASE {' '.join(whens)} ELSE {built} || ': ' || value || ' (vs ' || ref || ')' END"


def _feat_sql() -> str:
    """CTEs ``cats`` and ``feat``: per-feature metadata computed from the data."""
    var_ord = case_map("variable", {c: i for i, c in enumerate(S.categorical)})
    analog = case_map("variable", {c: S.analog.get(c, c) for c in S.categorical})
    display = case_map("variable", {c: TX.DISPLAY_VARIABLE.get(S.analog.get(c, c), S.analog.get(c, c))
                                    for c in S.categorical})
    gloss = case_map("variable", {c: TX.GLOSSARY.get(S.analog.get(c, c), TX.GLOSSARY_DEFAULT) for c in S.categorical},
                     TX.GLOSSARY_DEFAULT)
    num_rows = "\n  UNION ALL ".join(
        f"SELECT {i} AS feature_ord, {lit(c)} AS feature, 'numerical' AS feature_type, {lit(c)} AS variable, "
        f"CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS reference_category, "
        f"{lit(S.analog.get(c, c))} AS analog_variable, {lit(c)} AS interpretable_name, "
        f"{lit(TX.DISPLAY_NUMERIC.get(S.analog.get(c, c), c))} AS simplified_name, "
        f"{lit(c + ' (numerical value)')} AS business_interpretation, "
        f"{lit(TX.GLOSSARY.get(S.analog.get(c, c), TX.GLOSSARY_DEFAULT))} AS business_meaning"
        for i, c in enumerate(S.numeric))
    n_num = len(S.numeric)
    return f"""cat_long AS ({long_sql('churn_features', S.categorical, (), 'VARCHAR')}),
cats AS (SELECT variable, value, {var_ord} AS var_ord,
                ROW_NUMBER() OVER (PARTITION BY variable ORDER BY value) AS vo,
                MIN(value) OVER (PARTITION BY variable) AS ref,
                string_agg(value, ', ') OVER (PARTITION BY variable ORDER BY value
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_values
         FROM (SELECT DISTINCT variable, value FROM cat_long WHERE value IS NOT NULL)),
feat AS (
  {num_rows}
  UNION ALL
  SELECT CAST({n_num - 1} + ROW_NUMBER() OVER (ORDER BY var_ord, value) AS INTEGER), variable || '_' || value,
         'categorical', variable, value, ref, {analog}, variable || ': ' || value || ' vs ' || ref,
         {_display_sql(display)},
         'When ' || variable || ' is ''' || value || ''' (vs ''' || ref || ''')', {gloss}
  FROM cats WHERE vo > 1)"""


FEAT = _feat_sql()

_IMP = """imp AS (SELECT feature, ROUND(AVG(ABS(contribution)), 9) AS shap_importance FROM attributions GROUP BY feature),
gi AS (SELECT feature, shap_importance, ROUND(shap_importance / SUM(shap_importance) OVER () * 100.0, 9) AS shap_importance_normalized,
              CAST(ROW_NUMBER() OVER (ORDER BY shap_importance DESC, feature) AS INTEGER) AS rank FROM imp),
dirn AS (SELECT feature, mean_shap,
                CASE WHEN mean_shap > GREATEST(1e-6, MAX(ABS(mean_shap)) OVER () * 0.01) THEN 'increases churn'
                     WHEN mean_shap < -GREATEST(1e-6, MAX(ABS(mean_shap)) OVER () * 0.01) THEN 'reduces churn'
                     ELSE 'neutral' END AS impact_direction
         FROM (SELECT feature, ROUND(AVG(contribution), 9) AS mean_shap FROM attributions GROUP BY feature))"""

_TF = """tf_all AS (SELECT a.customer_id,
                  CAST(ROW_NUMBER() OVER (PARTITION BY a.customer_id ORDER BY ABS(a.contribution) DESC, f.feature_ord) AS INTEGER) AS factor_rank,
                  a.feature, COALESCE(f.simplified_name, a.feature) AS simplified_name, a.contribution,
                  ABS(a.contribution) AS abs_contribution,
                  CASE WHEN a.contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction
           FROM attributions a LEFT JOIN feat f ON a.feature = f.feature),
tf AS (SELECT * FROM tf_all WHERE factor_rank <= 10)"""


def _action_sql(name: str, d: str) -> str:
    svc, ffl, inc, soc, hotel, age = TX.ACTION_RULES
    up, down = f"{d} = 'increases churn'", f"{d} = 'reduces churn'"

    def has(x):
        return f"contains({name}, {lit(x)})"
    return f"""CASE WHEN {has(svc[0])} AND {up} THEN {lit(svc[1])} WHEN {has(svc[0])} AND {down} THEN {lit(svc[2])}
     WHEN {has(ffl[0])} THEN CASE WHEN {up} THEN {lit(ffl[1])} ELSE {lit(ffl[2])} END
     WHEN {has(inc[0])} THEN CASE WHEN {has('Low')} THEN {lit(inc[1])} ELSE {lit(inc[2])} END
     WHEN {has(soc[0])} THEN CASE WHEN {up} THEN {lit(soc[1])} ELSE {lit(soc[2])} END
     WHEN {has(hotel[0])} THEN CASE WHEN {up} THEN {lit(hotel[1])} ELSE {lit(hotel[2])} END
     WHEN {has(age[0])} THEN CASE WHEN {up} THEN {lit(age[1])} ELSE {lit(age[2])} END
     WHEN {up} THEN {lit(TX.ACTION_FALLBACK_UP)} WHEN {down} THEN {lit(TX.ACTION_FALLBACK_DOWN)} ELSE '' END"""


# ---- queries ------------------------------------------------------------------------------------------------

@register("linear_attribution", sql_with(V, "SELECT * FROM attributions"), ("X1", "F10"))
def q_linear_attribution(spark, sf_dir):
    return attributions(spark, sf_dir)


#: intercept of the fixed linear weights
MARGIN_INTERCEPT = 0.3


def _margin_sql() -> str:
    means = [f"{w} * AVG(CAST({name if ind is None else f'CASE WHEN {ind[0]} = {lit(ind[1])} THEN 1 ELSE 0 END'} AS DOUBLE))"
             for name, ind, w in ATTRIBUTION_WEIGHTS]
    return f"SELECT COUNT(*) AS n_background, ROUND({MARGIN_INTERCEPT} + {' + '.join(means)}, 9) AS expected_value FROM churn_features"


@register("expected_margin", sql_with(["churn_features"], _margin_sql()), ("X12",))
def q_expected_margin(spark, sf_dir):
    """Base value of ``linear_attribution``: the mean margin over all customers."""
    base = ex.linear_base(churn_features(spark, sf_dir), attribution_terms(), MARGIN_INTERCEPT)
    return base.withColumn("expected_value", stable(F.col("expected_value")))


@register("global_importance", sql_with(V, f"WITH {_IMP} SELECT * FROM gi"), ("X6", "A31", "A36", "W1", "T1", "W2"))
def q_global_importance(spark, sf_dir):
    return ex.global_importance(attributions(spark, sf_dir))


@register("impact_direction", sql_with(V, f"WITH {_IMP} SELECT * FROM dirn"), ("A32",))
def q_impact_direction(spark, sf_dir):
    return ex.impact_direction(attributions(spark, sf_dir))


@register("business_interpretation", sql_with(V, f"""
WITH {_IMP}, {FEAT}
SELECT gi.rank, gi.feature, COALESCE(f.feature_type, 'numerical') AS feature_type,
       COALESCE(f.business_interpretation, gi.feature || ' (numerical value)') AS business_interpretation,
       COALESCE(f.business_meaning, {lit(TX.GLOSSARY_DEFAULT)}) AS business_meaning,
       d.impact_direction, d.mean_shap, gi.shap_importance, gi.shap_importance_normalized,
       gi.shap_importance_normalized AS confidence_pct,
       {_action_sql("COALESCE(CASE WHEN f.feature_type = 'numerical' THEN f.analog_variable ELSE f.analog_variable || '_' || f.value END, gi.feature)", "d.impact_direction")} AS recommended_action
FROM gi JOIN dirn d ON gi.feature = d.feature LEFT JOIN feat f ON gi.feature = f.feature"""),
          ("X7", "X8", "J2", "J3", "D4", "P16", "P17", "F2", "F3", "F6"))
def q_business_interpretation(spark, sf_dir):
    cf = churn_features(spark, sf_dir)
    return ex.business_interpretation(attributions(spark, sf_dir, cf), feature_meta(spark, sf_dir, cf))


@register("feature_dictionary", sql_with(["churn_features"], f"WITH {FEAT} SELECT * FROM feat"),
          ("X10", "R6", "J2", "J3", "F2", "F3", "F6", "F14"))
def q_feature_dictionary(spark, sf_dir):
    return feature_meta(spark, sf_dir)


@register("reference_categories", sql_with(["churn_features"], f"""
WITH {FEAT}
SELECT variable AS categorical_feature, ref AS reference_category, MIN(all_values) AS all_categories,
       COALESCE(string_agg(CASE WHEN vo > 1 THEN variable || '_' || value END, ', ' ORDER BY value), '') AS encoded_features_in_model
FROM cats GROUP BY variable, ref"""), ("X9", "F7", "P4"))
def q_reference_categories(spark, sf_dir):
    cats = distinct_values(churn_features(spark, sf_dir), list(S.categorical))
    rows = [(c, v[0] if v else None, ", ".join(v), ", ".join(f"{c}_{x}" for x in v[1:])) for c, v in cats.items()]
    return literal_frame(spark, rows, [("categorical_feature", "string"), ("reference_category", "string"),
                                       ("all_categories", "string"), ("encoded_features_in_model", "string")])


@register("contrib_split", sql_with(V, """
SELECT customer_id, ROUND(COALESCE(SUM(CASE WHEN contribution > 0 THEN contribution END), 0.0), 9) AS total_positive,
       ROUND(COALESCE(SUM(CASE WHEN contribution < 0 THEN contribution END), 0.0), 9) AS total_negative,
       CAST(SUM(CASE WHEN contribution > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_increasing,
       CAST(SUM(CASE WHEN contribution < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_decreasing
FROM attributions GROUP BY customer_id"""), ("A33", "P19"))
def q_contrib_split(spark, sf_dir):
    s = ex.contrib_split(attribution_rows(spark, sf_dir))
    return s.withColumn("total_positive", stable(F.col("total_positive"))).withColumn(
        "total_negative", stable(F.col("total_negative")))


@register("top_factors", sql_with(V, f"WITH {FEAT}, {_TF} SELECT * FROM tf"), ("X11", "W3", "R7", "T8"))
def q_top_factors(spark, sf_dir):
    return factor_frame(spark, sf_dir).select("customer_id", F.inline("factors"))


@register("dependence_list", sql_with(V, f"""
WITH {_IMP}
SELECT rank AS plot_rank, feature, 'shap_dependence_' || translate(feature, ' /:', '___') || '.png' AS file_name
FROM gi WHERE rank <= 4"""), ("T4", "F4"))
def q_dependence_list(spark, sf_dir):
    gi = ex.global_importance(attributions(spark, sf_dir))
    return (gi.where(F.col("rank") <= 4)
            .select(F.col("rank").alias("plot_rank"), "feature",
                    F.concat(F.lit("shap_dependence_"), F.translate("feature", " /:", "___"), F.lit(".png"))
                    .alias("file_name")))


@register("top_shap_features", sql_with(V, f"WITH {_IMP} SELECT * FROM gi WHERE rank <= 3"), ("T3",))
def q_top_shap_features(spark, sf_dir):
    gi = ex.global_importance(attributions(spark, sf_dir))
    return ex.top_features(gi, 3).drop("top_rank")
