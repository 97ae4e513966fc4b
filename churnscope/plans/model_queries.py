"""Fitted-model queries (M6-M16, S10-S12, X2-X4, P18, R12, R13) over ``churn_features``.

Not SQL-expressible (trained models, seeded sampling): registered without oracle SQL;
their properties are tested in tests/test_models.py.
"""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.operators import attribute
from churnscope.operators import models as M
from churnscope.operators import prepare
from churnscope.operators.evaluate import leaderboard
from churnscope.operators.explain import top_features
from churnscope.operators.score import score_records
from churnscope.plans.registry import register
from churnscope.session import ensure_checkpoint_dir
from churnscope.sources.fixtures import churn_features, raw_records, sql_with
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
_BENCHES: dict = {}


def benchmark(spark, sf_dir, names=M.MODEL_NAMES) -> M.Benchmark:
    """Split, prepare (written once to the checkpoint folder) and fit the models; the
    fitted state is kept per session and input folder, so the queries below share it."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    bench = _BENCHES.get(key)
    if bench is None:
        split = prepare.stratified_split(churn_features(spark, sf_dir), S).checkpoint(eager=True)
        prep, data = M.prepare_frame(split, S)
        bench = M.Benchmark(S, prep, data)
        _BENCHES[key] = bench
    return M.fit_models(bench, names)


def _metrics(spark, sf_dir):
    bench = benchmark(spark, sf_dir)
    return M.model_metrics(M.predictions(bench)), bench


def best_model(spark, sf_dir) -> tuple:
    """Name and accuracy of the model with the highest F1 (first in benchmark order on
    ties; one row per model, so the pick is a tiny collect)."""
    metrics, bench = _metrics(spark, sf_dir)
    rows = metrics.orderBy(F.desc("f1"), "model_ord").select("model", "accuracy", "f1").collect()
    best = next((r for r in rows if r.f1 > 0), rows[0])
    return best.model, best.accuracy, bench


@register("train_logistic", None, ("M6", "M12"))
def q_train_logistic(spark, sf_dir):
    bench = benchmark(spark, sf_dir, (M.LR,))
    return M.model_importance(spark, M.LR, bench.models[M.LR], bench.prep.feature_names)


@register("train_forest", None, ("M7", "M13"))
def q_train_forest(spark, sf_dir):
    bench = benchmark(spark, sf_dir, (M.RF,))
    return M.model_importance(spark, M.RF, bench.models[M.RF], bench.prep.feature_names)


@register("train_gbt", None, ("M8", "M13"))
def q_train_gbt(spark, sf_dir):
    bench = benchmark(spark, sf_dir, (M.GB,))
    return M.model_importance(spark, M.GB, bench.models[M.GB], bench.prep.feature_names)


@register("train_mlp", None, ("M9", "S12"))
def q_train_mlp(spark, sf_dir):
    """The network in the reference's shape; ``model_benchmark`` and the others keep the small one."""
    shared = benchmark(spark, sf_dir, ())
    bench = M.fit_models(M.Benchmark(S, shared.prep, shared.data), (M.NN,), mlp_hidden=M.WIDE_HIDDEN)
    rows = M.training_history(bench.models[M.NN], M.NN)
    return spark.createDataFrame(rows, "model string, iteration int, loss double")


@register("permutation_importance", None, ("M10", "A35", "D3"))
def q_permutation_importance(spark, sf_dir):
    bench = benchmark(spark, sf_dir, (M.NN,))
    return M.permutation_importance(bench, M.NN)


@register("predictions", None, ("M14", "J4"))
def q_predictions(spark, sf_dir):
    return M.predictions(benchmark(spark, sf_dir))


@register("model_benchmark", None, ("M15", "A26", "A27", "A28", "T7"))
def q_model_benchmark(spark, sf_dir):
    metrics, _ = _metrics(spark, sf_dir)
    return leaderboard(metrics)


@register("model_registry", None, ("M16", "R13", "S5", "S9", "S10", "S11", "T3", "T5"))
def q_model_registry(spark, sf_dir):
    """Per model: metrics, top-5 features and artifact path; the best model flagged.
    Models, preparation and the per-model results are published as one version under the checkpoint
    folder (S10, S11): each model with MLlib's writer, and by model its metrics, report, importances
    and test predictions; readers take the set by its manifest."""
    from churnscope.operators.evaluate import classification_report
    from churnscope.sources import artifacts, sinks
    metrics, bench = _metrics(spark, sf_dir)
    imp = None
    for n in bench.models:
        part = (M.permutation_importance(bench, n) if n == M.NN
                else M.model_importance(spark, n, bench.models[n], bench.prep.feature_names))
        part = part.select("model", "feature", "importance", "importance_type")
        imp = part if imp is None else imp.unionByName(part)
    imp = imp.checkpoint(eager=True)  # the top five and the published table read it
    top5 = (top_features(imp, 5, ["model"], order_col="importance")
            .groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top_rank", "feature"))),
                                                           lambda s: s.getField("feature")), ", ").alias("top_features")))
    lb = leaderboard(metrics)
    # one row per model: a global window over it is bounded
    best_rank = F.min(F.when(F.col("f1") > 0, F.col("rank"))).over(Window.partitionBy())
    out = lb.join(top5, "model", "left").withColumn("is_best", F.col("rank") == best_rank).checkpoint(eager=True)
    file_name = F.lower(F.regexp_replace("model", " ", "_"))
    pred = M.predictions(bench)

    def write(folder):
        M.save_models(bench, folder)
        report = classification_report(pred, ["model"], "true_label", "predicted_label")
        for name, t in {"metrics": out, "importance": imp, "predictions": pred, "report": report}.items():
            t.withColumn("model_file", file_name).write.partitionBy("model_file").json(f"{folder}/results/{name}")
        sinks.write_table(out, folder, "all_model_results", "json")

    folder = artifacts.publish(spark, os.path.join(ensure_checkpoint_dir(spark), "models"), write)
    return out.withColumn("model_path", F.concat(F.lit(folder + "/"), file_name, F.lit("/model")))


def background(bench: M.Benchmark) -> list:
    """The background of the attributions below but the random-order one: at most 50 training rows in a seeded hash order."""
    return attribute.sample_background(bench.train, S.key, bench.prep.feature_names)


def attribution_by_kind(bench: M.Benchmark, name: str, rows=None):
    """The attribution that fits the model's kind: the closed form of the linear model's margin, tree attribution of the
    forest's probability or the boosted model's margin, kernel attribution of any other model's probability."""
    rows, names = bench.test if rows is None else rows, bench.prep.feature_names
    args = (rows, bench.models[name], S.key, names, background(bench))
    if name == M.LR:
        return attribute.linear_attribution(*args)
    if name in (M.RF, M.GB):
        return attribute.tree_attribution(*args, boosted=name == M.GB)
    return attribute.kernel_attribution(*args)


@register("shapley_attribution", None, ("X12", "D3"))
def q_shapley_attribution(spark, sf_dir):
    """The best model's attribution, by its kind, of every test row."""
    name, _, bench = best_model(spark, sf_dir)
    return attribution_by_kind(bench, name).withColumn("model", F.lit(name))


@register("kernel_attribution", None, ("X2", "X12", "D3"))
def q_kernel_attribution(spark, sf_dir):
    """Kernel attribution of the network on every test row: 100 coalitions, 50 background rows."""
    bench = benchmark(spark, sf_dir, (M.NN,))
    return attribute.kernel_attribution(bench.test, bench.models[M.NN], S.key, bench.prep.feature_names, background(bench)).withColumn("model", F.lit(M.NN))


@register("permutation_attribution", None, ("X4", "X12", "D3"))
def q_permutation_attribution(spark, sf_dir):
    """Random-order attribution of the network on every test row against all training rows, with its standard error."""
    bench = benchmark(spark, sf_dir, (M.NN,))
    names = bench.prep.feature_names
    return attribute.permutation_attribution(bench.test, bench.models[M.NN], S.key, names, attribute.whole_background(bench.train, names)).withColumn("model", F.lit(M.NN))


@register("tree_attribution", None, ("X3", "X12"))
def q_tree_attribution(spark, sf_dir):
    """Tree attribution of the forest's probability and the boosted model's margin on every test row."""
    bench = benchmark(spark, sf_dir, (M.RF, M.GB))
    parts = [attribution_by_kind(bench, n).withColumns({"model": F.lit(n), "output": F.lit(o)}) for n, o in ((M.RF, "probability"), (M.GB, "margin"))]
    return parts[0].unionByName(parts[1])


@register("linear_model_attribution", None, ("X1", "X12"))
def q_linear_model_attribution(spark, sf_dir):
    """The fitted logistic regression's margin, in closed form, on every test row."""
    bench = benchmark(spark, sf_dir, (M.LR,))
    return attribution_by_kind(bench, M.LR).withColumn("model", F.lit(M.LR))


@register("explain_sample", sql_with(["churn_features", "churn_split"], """
SELECT customer_id, target FROM churn_split WHERE split = 'test'
ORDER BY ((customer_id % 1000003) * 427799) % 1000003, customer_id LIMIT 200"""), ("P18",))
def q_explain_sample(spark, sf_dir):
    """The 200-row explanation sample of the test rows (portable order, so the same
    rows can be picked in SQL)."""
    split = prepare.stratified_split(churn_features(spark, sf_dir), S, order="portable")
    return M.explain_sample(split.where(F.col("split") == "test"), S.key, 200, order="portable") \
        .select(S.key, "target")


@register("score_batch", None, ("R12", "S14", "F15", "F16"))
def q_score_batch(spark, sf_dir):
    name, acc, bench = best_model(spark, sf_dir)
    return score_records(raw_records(spark, sf_dir), bench, name, acc)


@register("stream_score", None, ("ST1",))
def q_stream_score(spark, sf_dir):
    """The raw records written as JSON files to a fresh folder under the checkpoint
    folder, scored by the streaming query (available-now trigger), read back."""
    import uuid

    from churnscope.streaming.scorer import read_output, start_scorer
    name, acc, bench = best_model(spark, sf_dir)
    root = os.path.join(ensure_checkpoint_dir(spark), "stream", uuid.uuid4().hex)
    raw_records(spark, sf_dir).write.mode("overwrite").json(os.path.join(root, "in"))
    q = start_scorer(spark, bench, name, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt"),
                     acc)
    q.awaitTermination()
    scored, rejected = read_output(spark, os.path.join(root, "out"))
    return scored.drop("batch_id").unionByName(
        rejected.drop("batch_id").select("customer_id", F.lit(False).alias("is_valid"), "errors"),
        allowMissingColumns=True)


@register("shap_summary", None, ("X9", "X6", "X7", "T4", "S5", "S4"))
def q_shap_summary(spark, sf_dir):
    """The attribution summary document of the best model: its name, feature count,
    the three most important features of the concise business table, the reference
    categories and the dependence-plot list; written as JSON and read back."""
    from churnscope.operators.explain import business_interpretation, dependence_list, feature_metadata
    from churnscope.sources import sinks

    name, _, bench = best_model(spark, sf_dir)
    attr = attribution_by_kind(bench, name).select(S.key, "feature", "contribution")
    attr = attr.checkpoint(eager=True)  # three aggregates read it
    meta = feature_metadata(spark, S, bench.prep.categories)
    concise = ("rank", "feature", "business_interpretation", "feature_type", "impact_direction", "mean_shap",
               "shap_importance", "shap_importance_normalized", "recommended_action")
    top3 = (business_interpretation(attr, meta).where(F.col("rank") <= 3)
            .agg(F.array_sort(F.collect_list(F.struct(*concise))).alias("v")))
    deps = (dependence_list(attr)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("plot_rank", "file_name"))),
                             lambda s: s.getField("file_name")).alias("v")))
    refs = [(c, v[0] if v else None, ", ".join(v), ", ".join(f"{c}_{x}" for x in v[1:])) for c, v in bench.prep.categories.items()]
    ref_arr = F.array(*[F.struct(F.lit(a).alias("categorical_feature"), F.lit(b).alias("reference_category"),
                                 F.lit(c).alias("all_categories"), F.lit(d).alias("encoded_features_in_model"))
                        for a, b, c, d in refs])
    # every part is one row: scalar subqueries put them side by side without a join
    doc = spark.range(1).select(
        F.lit(name).alias("model_name"), F.lit(len(bench.prep.feature_names)).alias("total_features"),
        top3.select("v").scalar().alias("top_3_features"), ref_arr.alias("reference_categories"),
        F.array(F.lit("shap_summary_bar.png")).alias("visualization_files"),
        deps.select("v").scalar().alias("dependence_plots"))
    path = os.path.join(ensure_checkpoint_dir(spark), "shap_results", uuid_hex())
    sinks.write_json_document(doc, path)
    return sinks.read_json(spark, path)


def uuid_hex() -> str:
    import uuid
    return uuid.uuid4().hex


@register("shap_importance_table", None, ("X6", "X7", "X8", "A31", "A32", "W1"))
def q_shap_importance_table(spark, sf_dir):
    """The enriched business table (every feature) over the best model's Shapley values
    for the test rows: rank, type, interpretation, meaning, direction, signed mean,
    importance and share, confidence and the recommended action."""
    from churnscope.operators.explain import business_interpretation, feature_metadata

    name, _, bench = best_model(spark, sf_dir)
    attr = attribution_by_kind(bench, name).select(S.key, "feature", "contribution").checkpoint(eager=True)
    return business_interpretation(attr, feature_metadata(spark, S, bench.prep.categories)) \
        .withColumn("model", F.lit(name))


@register("prepared_outputs", None, ("S6", "S7", "M1", "M2", "M3", "P2"))
def q_prepared_outputs(spark, sf_dir):
    """The preparation outputs as files: processed and raw feature matrices and targets
    of both splits (distributed CSV writes, one folder each, run-stamped); returns the
    index with row counts read back."""
    from churnscope.sources import sinks

    bench = benchmark(spark, sf_dir, ())
    names = bench.prep.feature_names
    split = prepare.stratified_split(churn_features(spark, sf_dir), S).checkpoint(eager=True)
    folder = sinks.run_folder(os.path.join(ensure_checkpoint_dir(spark), "prepared"), "prepared_data")
    tables = {}
    for part in ("train", "test"):
        proc = bench.data.where(F.col("split") == part)
        tables[f"X_{part}_processed"] = proc.select(*[F.col(f"`{n}`") for n in names])
        tables[f"y_{part}_raw"] = proc.select(F.col("label").cast("int").alias("Target"))
        tables[f"X_{part}_raw"] = split.where(F.col("split") == part).select(*S.features)
    rows = []
    for t, df in tables.items():
        path = sinks.write_table(df, folder, t, "csv", single_file=False)
        rows.append((t, path, spark.read.option("header", True).csv(path).count()))
    return spark.createDataFrame(rows, "table_name string, path string, rows long")


@register("score_json_lines", None, ("S14", "R12", "F15"))
def q_score_json_lines(spark, sf_dir):
    """Customer records as JSON text lines (as a request body or a message value would
    carry them): written to a fresh folder under the checkpoint folder, read as text,
    parsed with ``from_json`` and scored by the batch scorer."""
    import uuid

    from churnscope.streaming.scorer import parse_records
    name, acc, bench = best_model(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), "json_lines", uuid.uuid4().hex)
    raw_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return score_records(parse_records(spark.read.text(path), S), bench, name, acc)
