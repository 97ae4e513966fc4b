"""Model benchmark: four MLlib classifiers on the prepared features, their importances,
predictions, permutation importance and Shapley attributions (M6-M16, S10-S12, X2-X4).

Training runs on one prepared frame (scaled numerics, drop-first one-hot, class
weights) written once to the shared checkpoint folder, so every iteration of every
estimator reads the same materialised rows and a lost executor re-reads them instead
of recomputing the whole lineage. All estimators are distributed MLlib algorithms
(tree aggregation over partitions).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.operators import attribute
from churnscope.operators.evaluate import evaluate_scores, predict_at
from churnscope.operators.prepare import Preparation, class_weights, fit_preparation, with_class_weight
from churnscope.operators.profile import fit_imputer, null_audit
from churnscope.functions.permute import keyed_permutation
from churnscope.functions.ranking import global_row_number
from churnscope.functions.stats import STAT_DIGITS, stable
from churnscope.session import ensure_checkpoint_dir, shuffle_partitions
from churnscope.sources.tables import literal_frame
from churnscope.spec import RoleSpec

# Benchmark order (first model wins an F1 tie) and artifact names.
LR, RF, GB, NN = "Logistic Regression", "Random Forest", "Gradient Boosting", "Artificial Neural Network"
MODEL_NAMES = (LR, RF, GB, NN)
IMPORTANCE_TYPE = {LR: "absolute_coefficient", RF: "gini_importance", GB: "split_importance",
                   NN: "permutation_importance"}
SEED = 42

#: rows of a partition of the prepared frame at most, on average: a frame of more rows is spread by its key before training
ROWS_PER_PARTITION = 32768
#: Sizes of the reference network's hidden layers
WIDE_HIDDEN = (128, 64, 32)


def artifact_name(name: str) -> str:
    """'Random Forest' -> 'random_forest' (the folder of a model's artifacts)."""
    return name.replace(" ", "_").lower()


def build_estimator(name: str, n_features: int, weight_sum: float | None = None, seed: int = SEED,
                    mlp_hidden: int | tuple = 16, mlp_iter: int = 100):
    """The four benchmark estimators with the reference's settings mapped to MLlib.

    Logistic regression: scikit-learn's liblinear objective with C = 1 divided by
    C * sum(w) gives MLlib's weighted mean loss + regParam/2 |b|^2, regParam = 1/sum(w).
    The network is re-aimed to MLlib's perceptron (sigmoid hidden layers, L-BFGS);
    ``mlp_hidden`` is the size of its hidden layer, or a tuple of several layers' sizes.
    """
    common = dict(featuresCol="features", labelCol="label")
    if name == LR:
        return LogisticRegression(weightCol="weight", regParam=1.0 / (weight_sum or 1.0), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000, tol=1e-8, fitIntercept=True, **common)
    if name == RF:
        # node ids cached and checkpointed (every 10 iterations, to spark.checkpoint.dir):
        # deep trees then read the training rows once per level, with short lineage
        return RandomForestClassifier(weightCol="weight", numTrees=100, maxDepth=10, minInstancesPerNode=2,
                                      featureSubsetStrategy="sqrt", bootstrap=True, seed=seed,
                                      cacheNodeIds=True, checkpointInterval=10, **common)
    if name == GB:
        return GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=2, subsamplingRate=0.8,
                             featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, checkpointInterval=10,
                             **common)
    if name == NN:
        hidden = [mlp_hidden] if isinstance(mlp_hidden, int) else list(mlp_hidden)
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=mlp_iter, blockSize=128,
                                              seed=seed, **common)
    raise ValueError(f"unknown model {name}")


@dataclass
class Benchmark:
    spec: RoleSpec
    prep: Preparation
    data: DataFrame            # key, label, weight, split, feature columns, features vector (checkpointed)
    models: dict = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")


def prepare_frame(split_df: DataFrame, spec: RoleSpec, prep: Preparation | None = None,
                  fit_on: str = "train", impute: bool = True) -> tuple:
    """Prepared rows for training and evaluation, written once to the checkpoint folder.

    Columns with nulls are imputed first (median / most frequent value, 'Unknown' for an
    all-null text column) with values fitted on the training rows (``fit_on='all'``
    fits them, and the scaler, on every row as the reference's preparation did)."""
    ensure_checkpoint_dir(split_df.sparkSession)
    train_rows = split_df.where(F.col("split") == "train") if fit_on == "train" else split_df
    if prep is None:
        fills = {}
        if impute:
            with_nulls = {r.column_name for r in null_audit(split_df.select(*spec.features)).collect()}
            if with_nulls:
                fills = fit_imputer(train_rows, [c for c in spec.numeric if c in with_nulls],
                                    [c for c in spec.categorical if c in with_nulls])
        prep = fit_preparation(train_rows, spec, fills=fills)
    weights = class_weights(split_df.where(F.col("split") == "train"), spec)  # one row per class
    rows = with_class_weight(split_df, spec, weights)
    data = prep.transform(rows, keep=[spec.key, F.col(spec.target).cast("double").alias("label"), "weight", "split"])
    return prep, spread(data, spec.key, split_df.count()).checkpoint(eager=True)


def spread(data: DataFrame, key: str, n: int) -> DataFrame:
    """``data`` of ``n`` rows in as many partitions as its rows ask for, in key order within each. The bytes that size a
    partition elsewhere say little here: the rows are narrow, and every iteration of every estimator works through all of
    them, so a frame of a few MB needs all cores. Bagging draws by partition and place, so it doesn't hinge on the cluster.
    A frame that fits one partition stays as it lies."""
    parts = -(-n // ROWS_PER_PARTITION)
    return data if parts <= 1 else data.repartition(parts, key).sortWithinPartitions(key)


def fit_models(bench: Benchmark, names=MODEL_NAMES, **kw) -> Benchmark:
    train = bench.train
    wsum = train.agg(F.sum("weight")).first()[0]
    n_feat = len(bench.prep.feature_names)
    for n in names:
        if n not in bench.models:
            bench.models[n] = build_estimator(n, n_feat, wsum, **kw).fit(train)
    return bench


def positive_probability(model: Model, df: DataFrame, out: str = "probability_1") -> DataFrame:
    """P(class 1) from MLlib's probability vector; class 1 when strictly above 0.5."""
    p = model.transform(df)
    return p.withColumn(out, vector_to_array("probability")[1]).withColumn("predicted", predict_at(F.col(out)))


def predictions(bench: Benchmark, names=None) -> DataFrame:
    """Test-set predictions of every model, long form (key, model, label, probability)."""
    key = bench.spec.key
    parts = []
    for n in names or list(bench.models):
        p = positive_probability(bench.models[n], bench.test)
        parts.append(p.select(key, F.lit(n).alias("model"), F.lit(MODEL_NAMES.index(n) + 1).alias("model_ord"),
                              F.col("label").cast("int").alias("true_label"),
                              F.col("predicted").alias("predicted_label"),
                              F.col("probability_1").alias("prediction_probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_metrics(preds: DataFrame) -> DataFrame:
    return evaluate_scores(preds.withColumnRenamed("true_label", "target").withColumnRenamed("prediction_probability", "score"),
                           ["model", "model_ord"])


# ---- M12 / M13: model-specific importances ----------------------------------------------------------

def model_importance(spark: SparkSession, name: str, model: Model, feature_names: list) -> DataFrame:
    """|coefficient| for the linear model, impurity importance for the trees."""
    if name == LR:
        vals = [abs(float(x)) for x in model.coefficients.toArray()]
    elif name in (RF, GB):
        vals = [float(x) for x in model.featureImportances.toArray()]
    else:
        raise ValueError(f"{name} has no built-in importance; use permutation_importance")
    rows = [(name, f, v, IMPORTANCE_TYPE[name]) for f, v in zip(feature_names, vals)]
    return literal_frame(spark, rows, [("model", "string"), ("feature", "string"), ("importance", "double"),
                                       ("importance_type", "string")])


def training_history(model: Model, name: str) -> list:
    """Loss per iteration (L-BFGS objective) for models that keep a training summary."""
    if not getattr(model, "hasSummary", False):
        return []
    summary = model.summary() if callable(model.summary) else model.summary
    return [(name, i, float(v)) for i, v in enumerate(summary.objectiveHistory)]


# ---- M10: permutation importance --------------------------------------------------------------------------

def permutation_importance(bench: Benchmark, name: str, repeats: int = 10, seed: int = SEED,
                           rows: DataFrame | None = None, n_buckets: int | None = None) -> DataFrame:
    """Increase of the squared error of P(class 1) when one feature's values are
    shuffled across rows, mean and population std over ``repeats`` shuffles.

    The rows are ranked once (``global_row_number`` by a hash order, written). Repeat r is a keyed permutation of the
    ranks 0..n-1 (``keyed_permutation``), so a row's partner is computed, not sorted for; one join brings the
    partner's features, and a generator makes one variant per feature that takes this feature from the partner.
    """
    spark = bench.data.sparkSession
    key = bench.spec.key
    names = bench.prep.feature_names
    nb = n_buckets or shuffle_partitions(spark)
    base = (rows if rows is not None else bench.test).select(key, "label", *[F.col(f"`{n}`") for n in names])
    model = bench.models[name]
    ensure_checkpoint_dir(spark)
    own = base.select(key, "label", F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("_own"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"),
                      F.lit(0).alias("_all"))
    ranked = global_row_number(own, ["_all"], ["_h", key], nb, out="_k").select("label", "_own", (F.col("_k") - 1).alias("_k")).checkpoint(eager=True)
    n = ranked.count()
    left = ranked.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    left = left.select("label", "_own", "rep", keyed_permutation(F.col("_k"), n, F.col("rep"), seed).alias("_k"))
    shuffled = left.join(ranked.select("_k", F.col("_own").alias("_partner")), "_k").withColumn("pf", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    mixed = F.transform("_own", lambda v, i: F.when(i == F.col("pf"), F.get("_partner", i)).otherwise(v))
    perm = positive_probability(model, shuffled.select("label", "pf", "rep", array_to_vector(mixed).alias("features")))
    err = (F.col("label") - F.col("probability_1")) ** 2
    mse_perm = perm.groupBy("pf", "rep").agg(F.avg(err).alias("mse"))
    mse0 = positive_probability(model, ranked.select("label", array_to_vector("_own").alias("features"))).agg(F.avg(err)).first()[0]  # one number
    feature = F.get(F.array(*[F.lit(x) for x in names]), F.col("pf")).alias("feature")
    return (mse_perm.withColumn("delta", F.col("mse") - F.lit(mse0))
            .groupBy(feature)
            .agg(F.avg("delta").alias("importance"), F.stddev_pop("delta").alias("importance_std"))
            .withColumn("model", F.lit(name)).withColumn("importance_type", F.lit(IMPORTANCE_TYPE[NN])))


# ---- X2 / X3 / X4 / X12: Shapley attribution --------------------------------------------------------------

def background_rows(bench: Benchmark, k: int = 1, seed: int = SEED) -> list:
    """Background for the attribution: k = 1 is the training mean (one aggregate row);
    k > 1 takes k training rows in a seeded hash order (a bounded sample)."""
    names = bench.prep.feature_names
    train = bench.train
    if k == 1:
        row = train.agg(*[F.avg(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]).first()
        return [[float(row[f"c{i}"]) for i in range(len(names))]]
    rows = (train.orderBy(F.xxhash64(F.lit(seed), F.col(bench.spec.key)), bench.spec.key).limit(k)
            .select(*[F.col(f"`{n}`") for n in names]).collect())
    return [[float(x) for x in r] for r in rows]


def shapley_attribution(bench: Benchmark, name: str, rows: DataFrame | None = None,
                        background: list | None = None) -> DataFrame:
    """Exact Shapley values of P(class 1) for every explained row: the value that all 2^F coalitions give.

    v(S) = mean over background rows b of f(x_S, b_rest). phi_j = sum_S v(S) * c_j(S) with c_j(S) = w(|S|-1) if j in S else
    -w(|S|), w(s) = s!(F-s-1)!/F!. Sum of phi = f(x) - f(background) (efficiency). A forest's probability is a sum over
    leaves, of each of which this sum over the coalitions has a closed form (``attribute.tree_arrays``); of any other model
    the coalitions are worked through (``attribute.exact_attribution``)."""
    key, names, model = bench.spec.key, bench.prep.feature_names, bench.models[name]
    bg = background or background_rows(bench)
    src = rows if rows is not None else bench.test
    # rounded to STAT_DIGITS so the values do not depend on the summation order (the
    # same rows give the same attribution whatever the partitioning, batch or stream)
    if len(names) > 16:
        raise ValueError("exact enumeration is for up to 16 features")
    if not isinstance(model, RandomForestClassificationModel):
        return attribute.exact_attribution(src, model, key, names, bg, digits=STAT_DIGITS)  # rounded once
    phi = attribute.by_key(attribute.tree_arrays(src, model, key, names, bg), [key], "phi", len(names), F.avg)
    base = attribute.expected_value(src, model, bg).scalar()
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("feature_ord"), stable(F.get("phi", F.lit(i))).alias("contribution")) for i, n in enumerate(names)])
    return phi.select(key, F.inline(items)).withColumn("expected_value", stable(base))


def explain_sample(df: DataFrame, key: str, k: int = 200, seed: int = SEED, order: str = "hash") -> DataFrame:
    """A deterministic k-row sample (seeded hash order, or the portable order of the
    split; top-k per partition, then a final merge), the reference's 'first 200 rows'
    without relying on file order."""
    k_col = F.col(key)
    o = ((k_col % F.lit(1000003)) * F.lit(2654435761 % 1000003)) % F.lit(1000003) if order == "portable" else F.xxhash64(F.lit(seed), k_col)
    return df.orderBy(o, key).limit(k)


# ---- S10 / S11: persistence ---------------------------------------------------------------------------------

def save_models(bench: Benchmark, root: str) -> dict:
    """Every fitted model with MLlib's writer, the fitted preparation as JSON."""
    paths = {}
    for n, m in bench.models.items():
        p = os.path.join(root, artifact_name(n), "model")
        m.write().overwrite().save(p)
        paths[n] = p
    spark = bench.data.sparkSession
    spark.createDataFrame([(bench.prep.to_json(),)], "preparation string").coalesce(1) \
        .write.mode("overwrite").json(os.path.join(root, "preparation"))
    return paths


def load_preparation(spark: SparkSession, root: str) -> Preparation:
    row = spark.read.json(os.path.join(root, "preparation")).first()
    return Preparation.from_json(row["preparation"])

