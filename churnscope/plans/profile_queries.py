"""Profile and imputation queries (S1-S3, P3, A1-A3) over ``churn_features`` / ``with_nulls``."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.operators import profile
from churnscope.plans.registry import register
from churnscope.plans.sqltext import values_table
from churnscope.sources.fixtures import churn_features, line_returns, sql_with, with_nulls
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
_CF_TYPES = [("customer_id", "bigint"), ("age", "integer"), ("frequent_buyer", "string"), ("income_class", "string"),
             ("services", "integer"), ("has_urgent", "string"), ("has_pending", "string"), ("target", "integer")]
_ROLES = {"customer_id": "key", "target": "target", "age": "numerical", "services": "numerical"}


@register("scan_profile", sql_with(["churn_features"], f"""
SELECT t.column_ord, t.column_name, t.data_type, (SELECT COUNT(*) FROM churn_features) AS row_count,
       CAST(0 AS BIGINT) AS null_count
FROM {values_table([(i, c, d) for i, (c, d) in enumerate(_CF_TYPES)], ['column_ord', 'column_name', 'data_type'])} t"""),
          ("S1", "S2"))
def q_scan_profile(spark, sf_dir):
    return profile.scan_profile(churn_features(spark, sf_dir))


@register("head_rows", sql_with(["churn_features"], "SELECT * FROM churn_features ORDER BY customer_id LIMIT 5"), ("S3",))
def q_head_rows(spark, sf_dir):
    return profile.head_rows(churn_features(spark, sf_dir), S)


@register("role_inference", sql_with(["churn_features"], f"""
SELECT t.*, n.n_values FROM {values_table([(i, c, d, _ROLES.get(c, 'categorical')) for i, (c, d) in enumerate(_CF_TYPES)],
                                          ['column_ord', 'column_name', 'data_type', 'role'])} t
JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, COUNT({c}) AS n_values FROM churn_features" for c, _ in _CF_TYPES)}) n
  ON n.column_name = t.column_name"""), ("P2", "P3"))
def q_role_inference(spark, sf_dir):
    return profile.infer_roles(churn_features(spark, sf_dir), S)


@register("null_audit", sql_with(["with_nulls"], """
SELECT * FROM (
  SELECT 0 AS column_ord, 'customer_id' AS column_name, CAST(COUNT(*) - COUNT(customer_id) AS BIGINT) AS null_count FROM with_nulls UNION ALL
  SELECT 1, 'age', CAST(COUNT(*) - COUNT(age) AS BIGINT) FROM with_nulls UNION ALL
  SELECT 2, 'income_class', CAST(COUNT(*) - COUNT(income_class) AS BIGINT) FROM with_nulls UNION ALL
  SELECT 3, 'all_null', CAST(COUNT(*) - COUNT(all_null) AS BIGINT) FROM with_nulls UNION ALL
  SELECT 4, 'services', CAST(COUNT(*) - COUNT(services) AS BIGINT) FROM with_nulls UNION ALL
  SELECT 5, 'target', CAST(COUNT(*) - COUNT(target) AS BIGINT) FROM with_nulls) WHERE null_count > 0"""), ("A1",))
def q_null_audit(spark, sf_dir):
    return profile.null_audit(with_nulls(spark, sf_dir))


@register("impute_mode", sql_with(["with_nulls"], """
WITH m AS (SELECT income_class AS v FROM with_nulls WHERE income_class IS NOT NULL
           GROUP BY income_class ORDER BY COUNT(*) DESC, income_class LIMIT 1)
SELECT customer_id, COALESCE(income_class, (SELECT v FROM m), 'Unknown') AS income_class,
       COALESCE(all_null, 'Unknown') AS all_null
FROM with_nulls"""), ("A2", "F12"))
def q_impute_mode(spark, sf_dir):
    df = with_nulls(spark, sf_dir)
    return profile.impute_nulls(df, S).select("customer_id", "income_class", "all_null")


@register("impute_median", sql_with(["with_nulls"], """
SELECT customer_id, COALESCE(CAST(age AS DOUBLE), (SELECT quantile_cont(age, 0.5) FROM with_nulls)) AS age,
       services, target
FROM with_nulls"""), ("A3",))
def q_impute_median(spark, sf_dir):
    df = with_nulls(spark, sf_dir)
    return profile.impute_nulls(df, S).select("customer_id", F.col("age").cast("double").alias("age"), "services",
                                              "target")


_LR_TYPES = [("l_orderkey", "bigint"), ("l_linenumber", "integer"), ("quantity", "integer"), ("discount", "double"),
             ("line_status", "string"), ("supplier_region", "string"), ("priority", "string"), ("target", "integer")]


@register("line_scan_profile", sql_with(["line_returns"], f"""
SELECT t.column_ord, t.column_name, t.data_type, (SELECT COUNT(*) FROM line_returns) AS row_count,
       CAST(0 AS BIGINT) AS null_count
FROM {values_table([(i, c, d) for i, (c, d) in enumerate(_LR_TYPES)], ['column_ord', 'column_name', 'data_type'])} t"""),
          ("S2",))
def q_line_scan_profile(spark, sf_dir):
    """Profile of the line-item view (the generic five-table join)."""
    return profile.scan_profile(line_returns(spark, sf_dir))
