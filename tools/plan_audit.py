"""Scan the physical plan of every registered query for patterns that do not scale:
cartesian products, nested-loop joins, single-partition exchanges, Python UDF
operators and full-column scans (developer tool).

Usage: python tools/plan_audit.py [sf_dir] [--no-broadcast]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnscope.plans.registry import load_all  # noqa: E402
from churnscope.session import get_spark  # noqa: E402

PATTERNS = {
    "cartesian": r"CartesianProduct",
    "nested_loop": r"BroadcastNestedLoopJoin",
    "single_partition": r"Exchange SinglePartition",
    "python_udf": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
}
SKIP_MODEL = {"train_logistic", "train_forest", "train_gbt", "train_mlp", "permutation_importance", "predictions",
              "model_benchmark", "model_registry", "shapley_attribution", "explain_sample", "score_batch",
              "stream_score", "eda_report", "prep_metadata", "prepared_outputs", "shap_summary",
              "shap_importance_table", "score_json_lines"}


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = args[0] if args else "/root/testdata/sf0.01"
    extra = {"spark.ui.showConsoleProgress": "false"}
    if "--no-broadcast" in sys.argv:
        extra["spark.sql.autoBroadcastJoinThreshold"] = "-1"  # plan as it would be with large inputs
    spark = get_spark("local[8]", shuffle_partitions=8, extra=extra)
    for name, q in load_all().items():
        if name in SKIP_MODEL and "--all" not in sys.argv:
            continue
        df = q.run(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        hits = {k: v for k, v in hits.items() if v}
        exchanges = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan))
        print(f"{name:28s} shuffles={exchanges:2d} {hits if hits else ''}")


if __name__ == "__main__":
    main()
