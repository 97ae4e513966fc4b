"""Kernel, permutation and tree attributions against plain enumeration on the same background."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnscope.operators import attribute as A

NAMES = [f"f{i}" for i in range(8)]


def frame(spark, n, nf, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, nf)), 2)
    y = (x[:, 0] * x[:, 1 % nf] + x[:, 2 % nf] > 0.3 * rng.standard_normal(n)).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], ["id", "label"] + [f"f{j}" for j in range(nf)])
    return df.withColumn("features", array_to_vector(F.array(*[F.col(f"f{j}") for j in range(nf)]))), x


@pytest.fixture(scope="module")
def data(spark):
    df, x = frame(spark, 300, 8, 1)
    df = df.checkpoint()
    return df, x, {"rf": RandomForestClassifier(numTrees=8, maxDepth=5, seed=1).fit(df), "gbt": GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(df),
                   "lr": LogisticRegression().fit(df)}


def enumerated(spark, model, x, background, score):
    """Shapley values by the definition: marginal gains over all subsets, one prediction a mixed row."""
    nf = x.shape[1]
    subsets = [s for k in range(nf + 1) for s in itertools.combinations(range(nf), k)]
    rows = []
    for i, r in enumerate(x):
        for s, on in enumerate(subsets):
            for b in background:
                m = np.array(b, float)
                m[list(on)] = r[list(on)]
                rows.append((i, s, m.tolist()))
    df = spark.createDataFrame(rows, "i int, s int, x array<double>").withColumn("features", array_to_vector("x"))
    v = {(r.i, frozenset(subsets[r.s])): r.v for r in score(model, df).groupBy("i", "s").agg(F.avg("f").alias("v")).collect()}
    out = np.zeros(x.shape)
    for i in range(len(x)):
        for j in range(nf):
            for s in map(frozenset, subsets):
                if j not in s:
                    w = math.factorial(len(s)) * math.factorial(nf - len(s) - 1) / math.factorial(nf)
                    out[i, j] += w * (v[i, s | {j}] - v[i, s])
    return out, v[0, frozenset()]


def values(df, n, nf=8, col="contribution"):
    out = np.full((n, nf), np.nan)
    for r in df.collect():
        out[r.id, r.feature_ord] = r[col]
        assert r.feature == f"f{r.feature_ord}"
    return out


@pytest.mark.parametrize("name,score,boosted", [("rf", A.probability, False), ("gbt", A.margin, True)])
def test_tree_kernel_and_exact_equal_enumeration(spark, data, name, score, boosted):
    df, x, models = data
    rows, bg = df.where("id < 4"), A.sample_background(df, "id", NAMES, 5)
    want, base = enumerated(spark, models[name], x[:4], bg, score)
    for got in (A.tree_attribution(rows, models[name], "id", NAMES, bg, boosted), A.exact_attribution(rows, models[name], "id", NAMES, bg, score),
                A.kernel_attribution(rows, models[name], "id", NAMES, bg, samples=300, score=score)):
        assert np.abs(values(got, 4) - want).max() < 1e-9
        assert got.first().expected_value == pytest.approx(base, abs=1e-9)


def test_drawn_kernel_is_efficient_and_near(spark, data):
    df, x, models = data
    rows, bg = df.where("id < 10"), A.sample_background(df, "id", NAMES, 10)
    got = A.kernel_attribution(rows, models["lr"], "id", NAMES, bg, samples=100)
    f = {r.id: r.f for r in A.probability(models["lr"], rows).collect()}
    phi, base = values(got, 10), got.first().expected_value
    assert all(phi[i].sum() + base == pytest.approx(f[i], abs=1e-9) for i in range(10))
    exact = values(A.exact_attribution(rows, models["lr"], "id", NAMES, bg), 10)
    assert np.abs(phi - exact).max() < 0.05


def test_permutation_agrees_within_its_error(spark, data):
    df, x, models = data
    rows, bg = df.where("id < 12"), A.sample_background(df, "id", NAMES, 6)
    got = A.permutation_attribution(rows, models["rf"], "id", NAMES, bg, error=0.004, batch=8, most=64).checkpoint()
    exact = values(A.exact_attribution(rows, models["rf"], "id", NAMES, bg), 12)
    phi, err = values(got, 12), values(got, 12, col="std_error")
    f = {r.id: r.f for r in A.probability(models["rf"], rows).collect()}
    assert all(phi[i].sum() + got.first().expected_value == pytest.approx(f[i], abs=1e-9) for i in range(12))
    z = np.abs(phi - exact) / np.maximum(err, 1e-9)
    assert (z[err > 1e-9] > 3).mean() < 0.03 and np.abs(phi - exact)[err <= 1e-9].max(initial=0) < 1e-9
    rounds = {r.id: r.rounds for r in got.collect()}
    assert all(n % 8 == 0 and n <= 64 for n in rounds.values()) and len(set(rounds.values())) > 1  # each record stops by itself
    done = [i for i in rounds if rounds[i] < 64]
    assert done and err[done].max() <= 0.004


def test_forty_features(spark):
    df, x = frame(spark, 120, 40, 3)
    names = [f"f{j}" for j in range(40)]
    model = LogisticRegression(regParam=0.1).fit(df)
    bg, rows = A.sample_background(df, "id", names, 4), df.where("id < 3")
    f = {r.id: r.f for r in A.probability(model, rows).collect()}
    for got in (A.permutation_attribution(rows, model, "id", names, bg, batch=2, most=4), A.kernel_attribution(rows, model, "id", names, bg, samples=400)):
        phi = values(got, 3, 40)
        assert all(phi[i].sum() + got.first().expected_value == pytest.approx(f[i], abs=1e-8) for i in range(3))
    with pytest.raises(ValueError):
        A.exact_attribution(rows, model, "id", names, bg)


def test_no_records_and_no_background(spark, data):
    df, _, models = data
    bg = A.sample_background(df, "id", NAMES, 2)
    none = df.where("id < 0")
    for got in (A.exact_attribution(none, models["lr"], "id", NAMES, bg), A.tree_attribution(none, models["rf"], "id", NAMES, bg),
                A.permutation_attribution(none, models["lr"], "id", NAMES, bg)):
        assert got.count() == 0
    with pytest.raises(ValueError):
        A.sample_background(none, "id", NAMES)


def test_network_is_explained_without_coalition_rows(spark, data):
    """The array form of a network and of a linear model is MLlib's probability, and its values are those of enumeration."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    df, x, models = data
    net = MultilayerPerceptronClassifier(layers=[8, 5, 3, 2], maxIter=15, seed=3).fit(df)
    rows, bg = df.where("id < 4"), A.sample_background(df, "id", NAMES, 5)
    for model in (net, models["lr"]):
        w, offset, rest = A.affine_probability(model)
        f = [r.f for r in A.probability(model, df).orderBy("id").select("f").collect()]
        assert np.abs(rest(x @ w + offset) - f).max() < 1e-12
    want, base = enumerated(spark, net, x[:4], bg, A.probability)
    for got in (A.exact_attribution(rows, net, "id", NAMES, bg), A.kernel_attribution(rows, net, "id", NAMES, bg, samples=300)):
        assert np.abs(values(got, 4) - want).max() < 1e-9
        assert got.first().expected_value == pytest.approx(base, abs=1e-9)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # the long form alone


def test_random_orders_are_the_same_as_rows_and_as_arrays(spark, data, monkeypatch):
    df, _, models = data
    rows, bg = df.where("id < 6"), A.sample_background(df, "id", NAMES, 4)
    args = (rows.union(rows.where("id = 1")), models["lr"], "id", NAMES, bg)  # a key twice
    cols = ("id", "feature_ord", "contribution", "std_error", "rounds")
    kinds = (lambda: A.permutation_attribution(*args, batch=2, most=4), lambda: A.kernel_attribution(*args).selectExpr("id", "feature_ord", "contribution", "0D AS std_error", "0 AS rounds"))
    for made in kinds:
        arrays = sorted(tuple(r) for r in made().select(*cols).collect())
        with monkeypatch.context() as m:
            m.setattr(A, "affine_probability", lambda model: None)
            plain = sorted(tuple(r) for r in made().select(*cols).collect())
        assert len(arrays) == len(plain) == 6 * 8
        assert np.abs(np.array(arrays) - np.array(plain)).max() < 1e-9


def test_tree_records_of_one_partition_are_spread_over_tasks(spark, data, monkeypatch):
    df, _, models = data
    rows, bg = df.where("id < 200").coalesce(1), A.sample_background(df, "id", NAMES, 5)
    whole = values(A.tree_attribution(rows, models["rf"], "id", NAMES, bg), 200)
    monkeypatch.setattr(A, "TREE_ROWS", 30)
    monkeypatch.setattr(A, "PATTERN_BITS", 2)  # longer paths by the patterns that occur
    got = A.tree_attribution(rows, models["rf"], "id", NAMES, bg)
    assert got.rdd.getNumPartitions() == 7
    assert np.abs(values(got, 200) - whole).max() < 1e-12


def test_random_orders_against_a_whole_background(spark, data, monkeypatch):
    """Every background row counts by how often it occurs; records and background in several blocks; the same for models of rows."""
    df, _, models = data
    train = df.where("id BETWEEN 20 AND 44")
    train = train.unionByName(train.where("id < 25")).unionByName(train.where("id < 25"))
    bg = A.whole_background(train, NAMES)
    assert bg.count() == 25 and bg.agg(F.sum("w")).first()[0] == train.count() == 35
    rows = df.where("id < 6").unionByName(df.where("id = 1").withColumn("id", F.lit(6).cast("long"))).unionByName(df.where("id = 2"))
    listed = [list(r.x) for r in bg.collect() for _ in range(r.w)]
    exact = values(A.exact_attribution(rows, models["lr"], "id", NAMES, listed), 7)
    f = {r.id: r.f for r in A.probability(models["lr"], rows).collect()}
    monkeypatch.setattr(A, "BLOCK_ROWS", 2)
    monkeypatch.setattr(A, "BLOCK_BACKGROUND", 7)
    for kind in (A.affine_probability, lambda model: None):
        monkeypatch.setattr(A, "affine_probability", kind)
        got = A.permutation_attribution(rows, models["lr"], "id", NAMES, bg, batch=4, most=8, error=0.001).checkpoint()
        phi, err = values(got, 7), values(got, 7, col="std_error")
        phi[2] /= 2  # a key twice: its rows add up
        assert np.abs(phi[1] - phi[6]).max() == 0 and got.count() == 7 * 8
        assert all(phi[i].sum() + got.first().expected_value == pytest.approx(f[i], abs=1e-9) for i in range(7))
        assert np.abs(phi - exact).max() < max(0.02, 6 * err.max())
    with pytest.raises(ValueError):
        A.permutation_attribution(rows, models["lr"], "id", NAMES, bg.where("w < 0"))


def test_the_random_order_query_explains_against_all_training_rows(spark):
    from churnscope.operators import models as M
    from churnscope.plans import model_queries as Q
    from conftest import SF_SMALL
    got = Q.q_permutation_attribution(spark, SF_SMALL).checkpoint()
    bench = Q.benchmark(spark, SF_SMALL, (M.NN,))
    mean = A.probability(bench.models[M.NN], bench.train).agg(F.avg("f")).first()[0]
    assert got.agg(F.min("expected_value"), F.max("expected_value")).first() == pytest.approx((mean, mean), abs=1e-9)
    f = {r[0]: r.f for r in A.probability(bench.models[M.NN], bench.test).select(Q.S.key, "f").collect()}
    sums = {r[0]: r.s for r in got.groupBy(Q.S.key).agg((F.sum("contribution") + F.max("expected_value")).alias("s")).collect()}
    assert sums.keys() == f.keys() and all(sums[k] == pytest.approx(f[k], abs=1e-9) for k in f)
