"""Rule queries (P13-P15, R3-R10, J6) over ``raw_records``, ``attributions``, ``scored``."""

from __future__ import annotations

from churnscope.functions import texts as TX
from churnscope.operators import evaluate as ev
from churnscope.operators import rules
from churnscope.operators.explain import factor_lists
from churnscope.plans.explain_queries import FEAT, _TF, factor_frame, feature_meta
from churnscope.plans.registry import register
from churnscope.plans.sqltext import lit, tiers
from churnscope.sources.fixtures import attribution_rows, churn_features, raw_records, score_expr, sql_with
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC


# ---- P13-P15 -------------------------------------------------------------------------------------
def _validate_sql() -> str:
    fields = ["age", "frequent_buyer", "income_class", "services", "has_urgent", "has_pending"]
    errs = [f"CASE WHEN {f} IS NULL THEN {lit('Missing field: ' + f)} WHEN trim({f}) = '' THEN {lit(f + ' is empty')} END"
            for f in fields]

    def present(c):
        return f"({c} IS NOT NULL AND trim({c}) <> '')"
    errs.append(f"CASE WHEN {present('age')} AND (TRY_CAST(age AS INTEGER) IS NULL OR TRY_CAST(age AS INTEGER) < 18 "
                f"OR TRY_CAST(age AS INTEGER) > 100) THEN 'age must be between 18 and 100' END")
    errs.append(f"CASE WHEN {present('services')} AND (TRY_CAST(services AS INTEGER) IS NULL OR "
                f"TRY_CAST(services AS INTEGER) < 1 OR TRY_CAST(services AS INTEGER) > 6) "
                f"THEN 'services must be between 1 and 6' END")
    errs.append(f"CASE WHEN {present('frequent_buyer')} AND frequent_buyer NOT IN ('Yes', 'No', 'No Record') "
                f"THEN 'frequent_buyer must be Yes, No, or No Record' END")
    cols = ",\n       ".join(f"{e} AS e{i}" for i, e in enumerate(errs))
    n = " + ".join(f"CASE WHEN e{i} IS NULL THEN 0 ELSE 1 END" for i in range(len(errs)))
    es = ", ".join(f"e{i}" for i in range(len(errs)))
    return f"""
WITH e AS (SELECT *, {cols} FROM raw_records)
SELECT customer_id, age, frequent_buyer, income_class, services, has_urgent, has_pending,
       TRY_CAST(age AS INTEGER) AS age_int, TRY_CAST(services AS INTEGER) AS services_int,
       ({n}) = 0 AS is_valid, CAST({n} AS INTEGER) AS n_errors, COALESCE({es}) AS first_error,
       concat_ws('; ', {es}) AS errors
FROM e"""


@register("validate_records", sql_with(["raw_records"], _validate_sql()), ("P13", "P14", "P15", "F8", "F13", "S8"))
def q_validate_records(spark, sf_dir):
    return rules.validate_records(raw_records(spark, sf_dir), S)


# ---- R8 ------------------------------------------------------------------------------------------------
_STRENGTH = "CASE WHEN abs_contribution > 0.1 THEN 'HIGH' WHEN abs_contribution > 0.05 THEN 'MEDIUM' " \
            "WHEN abs_contribution > 0.01 THEN 'LOW' ELSE 'MINIMAL' END"


@register("impact_strength", sql_with(["attributions"], f"""
WITH {FEAT}, {_TF}
SELECT customer_id, factor_rank, feature, abs_contribution, {_STRENGTH} AS impact_strength FROM tf"""), ("R8",))
def q_impact_strength(spark, sf_dir):
    from pyspark.sql import functions as F
    top = factor_frame(spark, sf_dir).select("customer_id", F.inline("factors"))
    return top.select("customer_id", "factor_rank", "feature", "abs_contribution",
                      rules.impact_strength(F.col("abs_contribution")).alias("impact_strength"))


# ---- R9 / J6 -------------------------------------------------------------------------------------------
def _text_sql(risk: bool) -> str:
    parts = []
    for key, risk_text, prot_text in TX.EXPLANATIONS:
        if risk and key == "age":
            text = (f"CASE WHEN contribution > {TX.AGE_SIGNIFICANT} THEN {lit(TX.RISK_TEXT_AGE_SIG)} "
                    f"ELSE {lit(TX.RISK_TEXT_AGE)} END")
        else:
            text = lit(risk_text if risk else prot_text)
        parts.append(f"WHEN contains(lower(simplified_name), {lit(key)}) THEN {text}")
    default = TX.RISK_TEXT_DEFAULT if risk else TX.PROTECTIVE_TEXT_DEFAULT
    return f"CASE {' '.join(parts)} ELSE {lit(default)} END"


@register("factor_explanations", sql_with(["attributions"], f"""
WITH {FEAT}, {_TF},
s AS (SELECT *, CASE WHEN contribution > 0 THEN 'increasing' ELSE 'decreasing' END AS side FROM tf WHERE contribution <> 0),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_id, side ORDER BY factor_rank) AS INTEGER) AS side_rank FROM s)
SELECT customer_id, side, side_rank, feature, simplified_name, contribution, {_STRENGTH} AS impact_strength,
       CASE WHEN side = 'increasing' THEN {_text_sql(True)} ELSE {_text_sql(False)} END AS explanation
FROM r WHERE side_rank <= 5"""), ("R9", "J6", "P19", "P20", "U2", "W3", "F1", "F5"))
def q_factor_explanations(spark, sf_dir):
    return rules.factor_explanations(rules.normalize_factors(factor_frame(spark, sf_dir)))


# ---- R10 --------------------------------------------------------------------------------------------------
@register("key_takeaways", sql_with(["attributions"], f"""
WITH {FEAT}, {_TF},
per AS (
  SELECT customer_id,
         ROUND(COALESCE(SUM(CASE WHEN contribution > 0 THEN abs_contribution END), 0.0), 9) AS total_risk,
         ROUND(COALESCE(SUM(CASE WHEN contribution < 0 THEN ABS(contribution) END), 0.0), 9) AS total_protection,
         arg_min(CASE WHEN contribution > 0 THEN simplified_name END, CASE WHEN contribution > 0 THEN factor_rank END) AS top_risk,
         arg_min(CASE WHEN contribution < 0 THEN simplified_name END, CASE WHEN contribution < 0 THEN factor_rank END) AS top_prot,
         CAST(SUM(CASE WHEN abs_contribution > 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant,
         SUM(CASE WHEN contribution > 0 THEN 1 ELSE 0 END) AS n_inc,
         SUM(CASE WHEN contribution < 0 THEN 1 ELSE 0 END) AS n_dec
  FROM tf GROUP BY customer_id),
items AS (
  SELECT customer_id, 1 AS pos, CASE WHEN total_risk > total_protection * {TX.TAKEAWAY_RATIO} THEN {lit(TX.TAKEAWAY_RISKY)}
                                     WHEN total_protection > total_risk * {TX.TAKEAWAY_RATIO} THEN {lit(TX.TAKEAWAY_PROTECTED)}
                                     ELSE {lit(TX.TAKEAWAY_BALANCED)} END AS t FROM per
  UNION ALL SELECT customer_id, 2, replace({lit(TX.TAKEAWAY_PRIMARY_RISK)}, '{{}}', top_risk) FROM per WHERE top_risk IS NOT NULL
  UNION ALL SELECT customer_id, 3, replace({lit(TX.TAKEAWAY_KEY_STRENGTH)}, '{{}}', top_prot) FROM per WHERE top_prot IS NOT NULL
  UNION ALL SELECT customer_id, 4, replace({lit(TX.TAKEAWAY_MULTIPLE)}, '{{}}', CAST(n_significant AS VARCHAR))
            FROM per WHERE n_significant > 5
  UNION ALL SELECT customer_id, 5, CASE WHEN n_inc > n_dec THEN {lit(TX.TAKEAWAY_FOCUS_RISK)}
                                        ELSE {lit(TX.TAKEAWAY_FOCUS_STRENGTH)} END FROM per),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY pos) AS rn FROM items)
SELECT p.customer_id, p.total_risk, p.total_protection, p.n_significant,
       CAST(COUNT(*) AS INTEGER) AS n_takeaways, string_agg(r.t, ' | ' ORDER BY r.pos) AS takeaways
FROM per p JOIN ranked r ON p.customer_id = r.customer_id AND r.rn <= 5
GROUP BY p.customer_id, p.total_risk, p.total_protection, p.n_significant"""), ("R10", "A34", "F9"))
def q_key_takeaways(spark, sf_dir):
    return rules.key_takeaways(factor_frame(spark, sf_dir))


# ---- R3 / R4 / R5 --------------------------------------------------------------------------------------------
def _rec_sql() -> str:
    inc = " ".join(f"WHEN income_class = {lit(k)} THEN {lit(v)}" for k, v in TX.REC_INCOME.items())
    ffl = " ".join(f"WHEN frequent_buyer = {lit(k)} THEN {lit(v)}" for k, v in TX.REC_FLYER.items())
    return f"""
WITH {FEAT}, {_TF},
fr AS (SELECT customer_id, 10 + factor_rank AS pos,
              CASE WHEN contains(lower(simplified_name), 'age') THEN {lit(TX.REC_FACTOR_AGE)}
                   WHEN contains(lower(simplified_name), 'income') AND contains(lower(simplified_name), 'low')
                        THEN {lit(TX.REC_FACTOR_INCOME_LOW)}
                   WHEN contains(lower(simplified_name), 'service') THEN {lit(TX.REC_FACTOR_SERVICE)} END AS t
       FROM tf WHERE factor_rank <= 3),
ar AS (
  SELECT customer_id, 1 AS pos, CASE WHEN age IS NOT NULL AND age <> 0 AND age < 30 THEN {lit(TX.REC_AGE_YOUNG)}
                                     WHEN age IS NOT NULL AND age <> 0 AND age > 50 THEN {lit(TX.REC_AGE_SENIOR)} END AS t
  FROM churn_features
  UNION ALL SELECT customer_id, 2, CASE {inc} END FROM churn_features
  UNION ALL SELECT customer_id, 3, CASE WHEN services IS NOT NULL AND services <> 0 AND services <= 2 THEN {lit(TX.REC_SERVICES_LOW)}
                                        WHEN services IS NOT NULL AND services <> 0 AND services >= 5 THEN {lit(TX.REC_SERVICES_HIGH)} END
            FROM churn_features
  UNION ALL SELECT customer_id, 4, CASE {ffl} END FROM churn_features
  UNION ALL SELECT customer_id, 5, CASE WHEN has_urgent = 'Yes' THEN {lit(TX.REC_SOCIAL_YES)} ELSE {lit(TX.REC_SOCIAL_NO)} END FROM churn_features
  UNION ALL SELECT customer_id, 6, CASE WHEN has_pending = 'Yes' THEN {lit(TX.REC_HOTEL_YES)} ELSE {lit(TX.REC_HOTEL_NO)} END FROM churn_features),
allr AS (SELECT * FROM ar WHERE t IS NOT NULL UNION ALL SELECT * FROM fr WHERE t IS NOT NULL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY pos) AS rn FROM allr),
recs AS (SELECT customer_id, CAST(COUNT(*) AS INTEGER) AS n, string_agg(t, ' | ' ORDER BY pos) AS txt
         FROM ranked WHERE rn <= 5 GROUP BY customer_id)
SELECT s.customer_id, s.score AS probability,
       {tiers("s.score", [(t[0], t[1]) for t in ev.RISK_TIERS], ev.RISK_LOW[0])} AS risk_level,
       {tiers("s.score", ev.ACTION_TEXT, ev.ACTION_DEFAULT)} AS recommendation,
       r.n AS n_recommendations, r.txt AS recommendations
FROM scored s JOIN recs r ON s.customer_id = r.customer_id"""


@register("recommendations", sql_with(["attributions", "scored"], _rec_sql()), ("R3", "R4", "R5", "T8", "F13"))
def q_recommendations(spark, sf_dir):
    cf = churn_features(spark, sf_dir)
    # one row per customer with features, score and contributions: no joins
    rows = attribution_rows(spark, sf_dir, cf.withColumn("score", score_expr(cf)), keep=[*S.features, "score"])
    return rules.recommendations(factor_lists(rows, feature_meta(spark, sf_dir, cf)), None, None, S)
