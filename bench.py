"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully computed into Spark's ``noop`` sink (every row produced, nothing
collected) and timed; prints one JSON line with the total and per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnscope.plans.registry import load_all  # noqa: E402
from churnscope.session import get_spark  # noqa: E402

HEADLINE = (
    # exploratory tables over line items (the largest derived table)
    "line_category_churn", "line_outlier_summary", "line_interaction_rates", "line_stats_by_target",
    # exploratory tables over customers
    "combined_category_churn", "stats_by_target", "outlier_summary", "interaction_rates", "correlation_matrix",
    "age_band_churn", "histogram", "density_curve",
    # preparation and evaluation
    "stratified_split", "feature_matrix", "model_leaderboard", "roc_auc", "classification_report",
    # attribution tables and rules
    "business_interpretation", "top_factors", "key_takeaways", "recommendations", "validate_records",
)


# fitted-model queries (training four estimators dominates); opt in with BENCH_MODELS=1
MODELS = ("model_benchmark", "shapley_attribution", "score_batch")


def run(name, q, spark, sf_dir) -> float:
    t0 = time.time()
    q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [a for a in sys.argv[1:]] or list(HEADLINE) + (list(MODELS) if os.environ.get("BENCH_MODELS") else [])
    # one shuffle partition per core at this size; on a cluster size it to the data
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = get_spark(f"local[{cpus}]", app_name="churnscope-bench", shuffle_partitions=parts,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.ui.showConsoleProgress": "false"})
    reg = load_all()
    # warm-up (JVM, code generation caches), not timed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        run("warmup", reg["combined_category_churn"], spark, warm)
    times = {}
    for n in names:
        times[n] = round(run(n, reg[n], spark, sf_dir), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
