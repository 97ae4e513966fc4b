"""Plan-level regression checks (as tools/plan_audit.py, with broadcasts disabled so the
plans look as they would with large inputs)."""
import re

import pytest

from churnscope.plans.registry import load_all
from conftest import SF_SMALL

FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas"
MODEL = {"train_logistic", "train_forest", "train_gbt", "train_mlp", "permutation_importance", "predictions",
         "model_benchmark", "model_registry", "kernel_attribution", "permutation_attribution", "tree_attribution", "linear_model_attribution",
         "shapley_attribution", "score_batch", "stream_score", "eda_report",
         "prep_metadata", "prepared_outputs", "shap_summary", "shap_importance_table", "score_json_lines"}


@pytest.fixture(scope="module")
def large_plans(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {n: q.run(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
               for n, q in load_all().items() if n not in MODEL}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_cartesian_nested_loop_or_python_operators(large_plans):
    bad = {n: re.findall(FORBIDDEN, p) for n, p in large_plans.items() if re.search(FORBIDDEN, p)}
    assert not bad


def test_line_categories_aggregate_before_the_supplier_join(large_plans):
    plan = large_plans["line_category_churn"]
    join = plan.index("SortMergeJoin [l_suppkey")
    # the partial aggregate by (supplier, status, priority) sits below the supplier join
    assert re.search(r"HashAggregate\(keys=\[l_suppkey#\d+L, l_linestatus", plan[join:])


def test_parquet_scans_read_only_needed_columns(large_plans):
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", large_plans["combined_category_churn"])
    assert scans
    for schema in scans:
        cols = {c.split(":")[0] for c in schema.split(",")}
        assert cols <= {"o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_custkey", "c_acctbal"}


def test_factor_rules_do_not_shuffle_records(spark):
    """Factor lists, totals, takeaways and explanations are expressions on each record's own array."""
    from pyspark.sql import functions as F

    from churnscope.operators import explain as ex
    from churnscope.operators import rules

    df = spark.range(100).select(F.col("id").alias("customer_id"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    meta = spark.createDataFrame([(0, "a", "A"), (1, "b", "B")], "feature_ord int, feature string, simplified_name string")
    terms = [("a", F.col("a"), 0.5), ("b", F.col("b"), -0.25)]
    rows = ex.factor_lists(ex.linear_contributions(df, "customer_id", terms), meta)
    for out in (rows, rules.key_takeaways(rows), rules.factor_explanations(rules.normalize_factors(rows)), ex.contrib_split(rows)):
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    # the same from long rows, which are grouped by the record
    long = ex.long_contributions(rows, "customer_id")
    again = ex.factor_lists(long, meta)
    assert sorted(map(str, rules.key_takeaways(again).collect())) == sorted(map(str, rules.key_takeaways(rows).collect()))
    tops = rows.select("customer_id", F.inline("factors"))
    assert sorted(map(str, rules.factor_explanations(tops).collect())) == sorted(map(str, rules.factor_explanations(rows).collect()))
