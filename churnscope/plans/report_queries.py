"""Report queries: the EDA tables written to a run-stamped folder, and the preparation
metadata as a JSON document read back (S4-S7, P1, P10, P12, M4)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from churnscope.operators import eda, prepare
from churnscope.plans.registry import register
from churnscope.session import ensure_checkpoint_dir
from churnscope.sources import sinks
from churnscope.sources.fixtures import churn_features, sql_with
from churnscope.sources.tables import read_csv, rename_if_present
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
# rounding of the reference's tables (presentation only)
DIGITS = {
    "target_summary": {"percentage": 2},
    "stats_by_target": {c: 2 for c in ("mean", "median", "mode", "std", "min", "max", "q1", "q3")},
    "age_group_churn_rates": {"churn_rate": 3},
    "combined_categorical_analysis": {"churn_rate": 3, "std_error": 3, "churn_rate_pct": 1},
    "services_churn_rates": {"churn_rate": 3, "churn_rate_pct": 1},
    "outlier_summary": {c: 2 for c in ("q1", "q3", "iqr", "lower_fence", "upper_fence", "outlier_percentage",
                                       "min_value", "max_value", "mean", "median", "mode")},
    "correlations_with_target": {"correlation": 3},
}


@register("eda_report", None, ("S6", "S7", "P1", "P10", "P12"))
def q_eda_report(spark, sf_dir):
    """Every exploratory table of the customer view, rounded as the reference rounds
    them, written as CSV with a header into ``eda_output_<run>/tables``; returns the
    index of written tables with their row counts (read back)."""
    cf = rename_if_present(churn_features(spark, sf_dir), {"Ages": "Age"})
    cf = cf.checkpoint(eager=True)  # one materialisation feeds a dozen tables
    m = eda.correlation_matrix(cf, S)
    tables = {
        "target_summary": eda.target_distribution(cf, S),
        "stats_by_target": eda.stats_by_target(cf, S),
        "overall_stats": eda.overall_stats(cf, S),
        "age_group_churn_rates": eda.band_churn(cf, S, S.age_bins),
        "combined_categorical_analysis": eda.combined_category_churn(cf, S),
        "services_frequency_distribution": eda.value_frequency(cf, "services"),
        "services_churn_rates": eda.value_churn(cf, S, "services"),
        "outlier_summary": eda.outlier_summary(cf, S),
        "outliers_detail": eda.outlier_detail(cf, S),
        "interactions": eda.interaction_rates(cf, S),
        "correlation_matrix": m,
        "correlations_with_target": eda.corr_with_target(cf, S, m),
    }
    for c in S.categorical:  # one table per categorical column, as well as the combined one
        tables[f"{c}_churn_stats"] = eda.category_churn(cf, S, c)
    tables = {k: eda.present(v, DIGITS.get(k, DIGITS["combined_categorical_analysis"] if k.endswith("_churn_stats")
                                           else {})) for k, v in tables.items()}
    folder = sinks.run_folder(os.path.join(ensure_checkpoint_dir(spark), "reports"))
    idx = sinks.write_tables(tables, folder, row_level=("outliers_detail",))
    counts = [(r.table_name, spark.read.option("header", True).csv(r.path).count()) for r in idx.collect()]
    return idx.join(spark.createDataFrame(counts, "table_name string, rows long"), "table_name")


@register("prep_metadata", None, ("S4", "S5", "M4"))
def q_prep_metadata(spark, sf_dir):
    """The preparation metadata (feature names, roles, category info, data shapes) as
    one JSON document, written and read back as multi-line JSON."""
    split = prepare.stratified_split(churn_features(spark, sf_dir), S).checkpoint(eager=True)
    prep = prepare.fit_preparation(split.where(F.col("split") == "train"), S)
    shapes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}  # two rows
    nf = len(prep.feature_names)
    info = F.create_map(*[x for c in prep.categorical for x in (
        F.lit(c), F.struct(F.array(*[F.lit(v) for v in prep.categories[c]]).alias("original_values"),
                           F.lit(prep.categories[c][0] if prep.categories[c] else None).cast("string").alias("reference_category"),
                           F.array(*[F.lit(e) for e in prep.encoded[c]]).alias("encoded_columns")))])
    doc = spark.range(1).select(
        F.array(*[F.lit(n) for n in prep.feature_names]).alias("feature_names"),
        F.array(*[F.lit(n) for n in prep.numeric]).alias("numerical_features"),
        F.array(*[F.lit(n) for n in prep.categorical]).alias("categorical_features"),
        info.alias("category_info"),
        F.create_map(F.lit("X_train_processed"), F.array(F.lit(shapes.get("train", 0)), F.lit(nf)),
                     F.lit("X_test_processed"), F.array(F.lit(shapes.get("test", 0)), F.lit(nf))).alias("data_shapes"),
        F.lit("Used drop='first' for one-hot encoding.").alias("encoding_note"))
    path = os.path.join(ensure_checkpoint_dir(spark), "metadata", sinks.run_stamp() + "_" + str(os.getpid()))
    sinks.write_json_document(doc, path)
    return sinks.read_json(spark, path)


@register("csv_scan", sql_with(["churn_features"], "SELECT * FROM churn_features"), ("S1", "S6"))
def q_csv_scan(spark, sf_dir):
    """The customer view written as CSV with a header (distributed, one file per task)
    and read back with its declared schema (no inference pass)."""
    cf = churn_features(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), "csv", sinks.run_stamp() + "_" + uuid.uuid4().hex[:8])
    sinks.write_table(cf, os.path.dirname(path), os.path.basename(path), "csv", single_file=False)
    return read_csv(spark, path, cf.schema)
