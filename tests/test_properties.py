"""Properties and hand-made edge cases (FIXTURES.md section 3) of the building blocks."""
import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.functions.binning import right_closed_bin
from churnscope.functions.ranking import exclusive_running_sum, global_row_number
from churnscope.operators import eda, evaluate, prepare, rules
from churnscope.spec import AGE_EDGES, AGE_LABELS, RoleSpec

ONE = RoleSpec(key="id", target="target", numeric=("x",), categorical=("c",))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (20, 21, 30, 31, 40, 60, 61)], "x int")
    got = [r.b for r in df.select(right_closed_bin(F.col("x"), AGE_EDGES, AGE_LABELS).alias("b")).collect()]
    assert got == [None, "20-29", "20-29", "30-39", "30-39", "50-59", None]


def test_mode_ties_take_lowest(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (None,)], "x int").withColumn("target", F.lit(0))
    r = eda.stats_by_target(df, ONE, ["x"]).first()
    assert r["mode"] == 1.0 and r["count"] == 4


def test_outlier_fences_both_sides(spark):
    vals = list(range(1, 21)) + [100, -50]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vals)], "id int, x int, target int")
    s = eda.outlier_summary(df, ONE, ["x"]).first()
    assert s.outlier_count == 2
    kinds = sorted(r.outlier_type for r in eda.outlier_detail(df, ONE, ["x"]).collect())
    assert kinds == ["High", "Low"]


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 5, i % 2, "a") for i in range(10)], "id int, x int, target int, c string")
    spec = RoleSpec(key="id", target="target", numeric=("x",), categorical=("c",),
                    corr_columns=(("x", "x", None), ("t", "target", None)), target_display="t")
    m = {(r.var_a, r.var_b): r.r for r in eda.correlation_matrix(df, spec).collect()}
    assert m[("x", "t")] is None
    prep = prepare.fit_preparation(df, spec)
    assert prep.stds["x"] == 0.0
    assert {r.x for r in prep.transform(df, vector=None).collect()} == {0.0}
    auc = evaluate.roc_auc(df.withColumn("score", F.lit(0.3))).first().roc_auc
    assert auc == 0.5


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "target int, score double") \
        .withColumn("predicted", evaluate.predict_at(F.col("score")))
    m = evaluate.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert evaluate.roc_auc(df).first().roc_auc is None


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([(1, 1.0, "a", 0), (2, 2.0, "b", 1)], "id int, x double, c string, target int")
    test = spark.createDataFrame([(3, 1.5, "c", 0)], "id int, x double, c string, target int")
    prep = prepare.fit_preparation(train, ONE)
    assert prep.feature_names == ["x", "c_b"]
    assert prep.transform(test, vector=None).first()["c_b"] == 0.0


def test_too_many_categories_is_an_error(spark):
    df = spark.createDataFrame([(i, float(i), str(i), 0) for i in range(30)], "id int, x double, c string, target int")
    with pytest.raises(ValueError):
        prepare.fit_preparation(df, ONE, max_categories=10)


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c"])  # one group holds a third of the rows
        rows.append((i, g, rnd.randint(0, 400) / 4.0, rnd.randint(0, 1)))
    return spark.createDataFrame(rows, "id int, g string, v double, y int")


def test_global_row_number_equals_plain_window(spark):
    df = _skewed(spark)
    got = global_row_number(df, ["g"], ["v", "id"], n_buckets=5, out="rk")
    want = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    j = got.join(want, ["id"]).where(F.col("rk") != F.col("rk2"))
    assert j.count() == 0 and got.count() == df.count()


def test_exclusive_running_sum_equals_plain_window(spark):
    hist = _skewed(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = exclusive_running_sum(hist, ["g"], "v", ["n"], n_buckets=4)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = hist.withColumn("n_ref", F.coalesce(F.sum("n").over(w), F.lit(0)))
    assert got.join(want, ["g", "v"]).where(F.col("n_before") != F.col("n_ref")).count() == 0


def test_auc_equals_pairwise_count(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), rnd.randint(0, 20) / 20.0) for _ in range(400)]  # many ties
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "target int, score double")
    assert evaluate.roc_auc(df, n_buckets=6).first().roc_auc == pytest.approx(brute, abs=1e-12)


def test_split_is_exact_and_deterministic(spark):
    df = _skewed(spark).withColumn("target", F.col("y"))
    spec = RoleSpec(key="id", target="target", numeric=("v",), categorical=("g",))
    s1 = prepare.stratified_split(df, spec, n_buckets=4)
    s2 = prepare.stratified_split(df, spec, n_buckets=7)
    alloc = {r.target: r.n_test for r in prepare.split_allocation(df, spec).collect()}
    got = {r.target: r["count"] for r in s1.where("split = 'test'").groupBy("target").count().collect()}
    assert got == alloc
    assert sum(alloc.values()) == -(-df.count() * 2 // 10)  # ceil(0.2 n)
    a = {r.id for r in s1.where("split = 'test'").collect()}
    b = {r.id for r in s2.where("split = 'test'").collect()}
    assert a == b  # bucket count does not change membership


def test_validation_of_sample_customer(spark):
    from churnscope.spec import CHURN_SPEC
    rec = spark.createDataFrame([(1, "45", "Yes", "High Income", "5", "Yes", "No"),
                                 (2, "abc", "Maybe", "  ", "9", "No", None)],
                                "customer_id long, age string, frequent_buyer string, income_class string, "
                                "services string, has_urgent string, has_pending string")
    got = {r.customer_id: r for r in rules.validate_records(rec, CHURN_SPEC).collect()}
    assert got[1].is_valid and got[1].n_errors == 0 and got[1].first_error is None
    assert not got[2].is_valid
    assert got[2].first_error == "Missing field: has_pending" or got[2].first_error == "income_class is empty"
    assert got[2].n_errors == 5


def test_sample_customer_recommendations(spark):
    from churnscope.spec import CHURN_SPEC
    cf = spark.createDataFrame([(1, 45, "Yes", "High Income", 5, "Yes", "No")],
                               "customer_id long, age int, frequent_buyer string, income_class string, services int, "
                               "has_urgent string, has_pending string")
    scores = spark.createDataFrame([(1, 0.65)], "customer_id long, score double")
    top = spark.createDataFrame([(1, 1, "Services Opted"), (1, 2, "Age"), (1, 3, "Income Class: Low Income (vs High Income)")],
                                "customer_id long, factor_rank int, simplified_name string")
    r = rules.recommendations(cf, scores, top, CHURN_SPEC).first()
    assert r.risk_level == "HIGH"
    recs = r.recommendations.split(" | ")
    assert recs == ["Provide premium concierge services and exclusive benefits",
                    "Create custom bundle discount for loyalty and service optimization review",
                    "Reward with frequent flyer loyalty points and travel upgrades",
                    "Engage through social media exclusive offers and referral program",
                    "Promote hotel booking packages with special discounts"]


def test_approx_quantiles_close_to_exact(spark):
    df = _skewed(spark).withColumn("target", F.col("y"))
    spec = RoleSpec(key="id", target="target", numeric=("v",), categorical=("g",))
    exact = {r.target: r for r in eda.stats_by_target(df, spec).collect()}
    approx = {r.target: r for r in eda.stats_by_target(df, spec, approx=True).collect()}
    for t in exact:
        for c in ("median", "q1", "q3"):
            assert abs(exact[t][c] - approx[t][c]) <= 0.5  # values are on a 0.25 grid over 0..100


def test_missing_column_fails_before_any_job(spark):
    df = spark.createDataFrame([(1, 0)], "id int, target int")
    with pytest.raises(ValueError, match="missing required columns"):
        eda.stats_by_target(df, ONE)
    with pytest.raises(ValueError, match="missing required columns"):
        prepare.fit_preparation(df, ONE)


def test_correlation_is_pairwise_with_nulls(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0), (5.0, 4.0), (6.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("target", F.lit(0))
    spec = RoleSpec(key="a", target="target", numeric=(), categorical=(),
                    corr_columns=(("a", "a", None), ("b", "b", None)), target_display="b")
    got = {(r.var_a, r.var_b): r.r for r in eda.correlation_matrix(df, spec).collect()}
    pairs = [(x, y) for x, y in rows if x is not None and y is not None]
    n = len(pairs)
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    cov = sum((x - mx) * (y - my) for x, y in pairs)
    want = cov / (sum((x - mx) ** 2 for x, _ in pairs) ** 0.5 * sum((y - my) ** 2 for _, y in pairs) ** 0.5)
    assert got[("a", "b")] == pytest.approx(want, abs=1e-9)


def test_unknown_category_is_flagged(spark):
    train = spark.createDataFrame([(1, 1.0, "a", 0), (2, 2.0, "b", 1)], "id int, x double, c string, target int")
    test = spark.createDataFrame([(3, 1.5, "c", 0), (4, 1.0, "b", 1), (5, 1.0, None, 0)],
                                 "id int, x double, c string, target int")
    prep = prepare.fit_preparation(train, ONE)
    got = {r.id: r.unknown_category for r in prep.transform(test, keep=["id"], vector=None, flag_unknown=True).collect()}
    assert got == {3: True, 4: False, 5: False}


def test_presented_rate_percent_comes_from_rounded_rate(spark):
    df = spark.createDataFrame([(0.0675, 6.75)], "churn_rate double, churn_rate_pct double")
    r = eda.present(df, {"churn_rate": 3, "churn_rate_pct": 1}).first()
    assert r.churn_rate == 0.068 and r.churn_rate_pct == 6.8


def test_all_null_categorical_has_no_encoded_columns(spark):
    from churnscope.operators.explain import feature_metadata
    df = spark.createDataFrame([(1, 1.0, None, 0), (2, 2.0, None, 1)], "id int, x double, c string, target int")
    prep = prepare.fit_preparation(df, ONE)
    assert prep.feature_names == ["x"]
    assert prep.category_info(spark).first().reference_category is None
    assert feature_metadata(spark, ONE, prep.categories).count() == 1


def test_split_with_a_hot_key_is_exact_and_keeps_keys_together(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", (i // 3) % 2 if i % 3 == 0 else i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid int, key string, target int")
    spec = RoleSpec(key="key", target="target", numeric=(), categorical=())
    s = prepare.stratified_split(df, spec, n_buckets=8, unique_key=False)
    assert s.count() == 3000 and s.select("rid").distinct().count() == 3000
    alloc = {r.target: r.n_test for r in prepare.split_allocation(df, spec).collect()}
    got = {r.target: r["count"] for r in s.where("split = 'test'").groupBy("target").count().collect()}
    assert got == alloc
    mixed = (s.groupBy("target", "key").agg(F.countDistinct("split").alias("k")).where("k > 1")
             .groupBy("target").count().collect())
    assert all(r["count"] <= 1 for r in mixed)  # at most one key per class straddles


def test_split_group_path_equals_unique_path_for_unique_keys(spark):
    df = _skewed(spark).withColumn("target", F.col("y"))
    spec = RoleSpec(key="id", target="target", numeric=("v",), categorical=("g",))
    a = {r.id: r.split for r in prepare.stratified_split(df, spec, n_buckets=4).collect()}
    b = {r.id: r.split for r in prepare.stratified_split(df, spec, n_buckets=4, unique_key=False).collect()}
    assert a == b


def test_ranks_with_more_buckets_than_distinct_values(spark):
    rows = [(i, i % 2, float(i % 5)) for i in range(300)]  # 5 distinct order values, 64 buckets
    df = spark.createDataFrame(rows, "id int, g int, v double")
    got = global_row_number(df, ["g"], ["v", "id"], n_buckets=64, out="rk")
    want = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.join(want, "id").where(F.col("rk") != F.col("rk2")).count() == 0


def test_split_stops_at_a_key_on_both_sides(spark):
    df = spark.createDataFrame([(7, 0)] * 10, "id int, target int")
    spec = RoleSpec(key="id", target="target", numeric=(), categorical=())
    with pytest.raises(Exception, match="unique_key=False"):
        prepare.stratified_split(df, spec).collect()
    assert prepare.stratified_split(df, spec, unique_key=False).where("split = 'test'").count() == 2


def test_split_has_no_window_over_the_rows(spark):
    """Only the key, class and place are dealt out; other columns never meet an exchange."""
    df = _skewed(spark).withColumn("target", F.col("y"))
    spec = RoleSpec(key="id", target="target", numeric=("v",), categorical=("g",))
    big = df.withColumn("wide", F.concat(F.lit("wide"), F.col("id").cast("string")))
    plan = prepare.stratified_split(big, spec)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("wide" in line or " v#" in line for line in windows)


def test_permutation_pairs_the_whole_table(spark):
    """One permutation a repeat: every row gives its features away once and takes another's once."""
    rows = [(i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v double")
    h = lambda tag: F.xxhash64(F.lit(1), F.lit(tag), F.col("id"))
    a = global_row_number(df.withColumn("_a", h("a")), [], ["_a", "id"], 8, out="_k")
    b = global_row_number(df.select(F.col("v").alias("pv"), "id", h("b").alias("_b")), [], ["_b", "id"], 8, out="_k")
    got = a.join(b.select("_k", "pv"), "_k").collect()
    assert sorted(r.pv for r in got) == [v for _, v in rows] and any(r.pv != r.v for r in got)
