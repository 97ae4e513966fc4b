"""Value dictionaries and sparse one-hot rows against the dense way, at a million values, and on edge rows."""
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from churnscope.operators import prepare, wide
from churnscope.sources.fixtures import churn_features
from churnscope.spec import CHURN_SPEC, RoleSpec
from conftest import SF_SMALL


def dense(r, n):
    out = [0.0] * n
    for i, v in zip(r["indices"], r["values"]):
        out[i] = v
    return out


def test_equals_the_dense_way(spark):
    df = churn_features(spark, SF_SMALL).withColumn(
        "income_class", F.when(F.col("customer_id") % 7 == 0, "Not seen").when(F.col("customer_id") % 11 != 0, F.col("income_class")))
    train = df.where("income_class != 'Not seen'")
    prep = prepare.fit_preparation(train, CHURN_SPEC)
    d = wide.fit_dictionary(train, CHURN_SPEC.categorical)
    names = {r.slot: r.feature for r in d.table().where("slot IS NOT NULL").collect()}
    assert [names[i] for i in range(d.size)] == prep.feature_names[len(CHURN_SPEC.numeric):]
    want = {r.customer_id: [float(r[c]) for c in prep.feature_names] for r in prep.transform(df, ["customer_id"], vector=None).collect()}
    numeric = [prep.scaled(c) for c in CHURN_SPEC.numeric]
    encoded = wide.sparse_features(df, d, numeric)
    got = {r.customer_id: dense(r, d.size + len(numeric)) for r in encoded.collect()}
    assert got == want
    vectors = wide.ml_vectors(encoded, d, len(numeric))
    assert {r.customer_id: list(r.features.toArray()) for r in vectors.collect()} == want
    model = LogisticRegression(labelCol="target", maxIter=3).fit(vectors)
    assert model.coefficients.size == len(prep.feature_names)


def test_a_million_values_and_hot_ones(spark):
    n = 1_500_000
    i = F.col("id")
    value = F.when(i % 3 == 0, "w").otherwise(F.format_string("v%09d", i))
    d = wide.fit_dictionary(spark.range(n).select(value.alias("x"), F.lit("same").alias("y")), ["x", "y"])
    assert d.sizes == (1_000_001, 1) and d.size == 1_000_000 and d.offsets == [0, 1_000_000]
    place = F.substring("value", 2, 9).cast("long")
    want = F.when(F.col("value") == "w", 1_000_000).otherwise(place - F.floor(place / 3) - 1)
    assert d.entries.where("var_ord = 0").where(F.col("idx") != want).count() == 0
    # a third known, a third unknown, the others of one row each
    probe = spark.range(300_000).select("id", F.when(i % 3 == 0, "w").when(i % 3 == 1, "no such").otherwise(value).alias("x"), F.lit("same").alias("y"))
    out = wide.sparse_features(probe, d)
    slot = F.when(i % 3 == 0, F.lit(999_999)).otherwise(i - F.floor(i / 3) - 2)
    right = F.when(i % 3 == 1, F.size("indices") == 0).otherwise((F.size("indices") == 1) & (F.try_element_at("indices", F.lit(1)) == slot))
    assert out.count() == 300_000 and out.where(~right).count() == 0


def test_edges(spark, tmp_path):
    long = "é" * 5000
    rows = [(1, "b", long), (2, "a", long + "x"), (2, "a", long + "x"), (3, None, None), (4, "", "z"), (5, "ü", "Z"), (None, "\U0001F600", "￿")]
    df = spark.createDataFrame(rows, "indices int, `a.b` string, c string")
    d = wide.fit_dictionary(df, ["a.b", "c"])
    for j, name in enumerate(("a.b", "c")):
        values = [r.value for r in d.table().where(F.col("variable") == name).orderBy("idx").collect()]
        assert values == sorted({r[j + 1] for r in rows} - {None})  # code points, as the dense way
    d.save(str(tmp_path / "dict"))
    again = wide.ValueDictionary.load(spark, str(tmp_path / "dict"), ["a.b", "c"])
    assert again.sizes == d.sizes == (5, 5)
    slots = {(r.variable, r.value): r.slot for r in again.table().collect()}
    got = sorted((r["a.b"] or "", r.c or "", list(r["indices"])) for r in wide.sparse_features(df, again).collect())
    assert got == sorted((a or "", c or "", [s for s in (slots.get(("a.b", a)), slots.get(("c", c))) if s is not None]) for _, a, c in rows)
    none = wide.fit_dictionary(df.limit(0), ["a.b"])
    assert none.size == 0 and none.table().count() == 0
    assert {tuple(r["indices"]) for r in wide.sparse_features(df, none).collect()} == {()}
    assert wide.sparse_features(df.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        wide.fit_dictionary(df, [])


def test_numbers_come_first_and_names_clash(spark):
    spec = RoleSpec(key="id", target="t", numeric=("x",), categorical=("values",))
    df = spark.createDataFrame([(1, 2.5, "q"), (2, None, "r"), (3, 0.0, "q")], "id int, x double, `values` string")
    d = wide.fit_dictionary(df, spec.categorical)
    got = {r.id: (r["indices"], r["values"]) for r in wide.sparse_features(df, d, spec.numeric).collect()}
    assert got == {1: ([0], [2.5]), 2: ([0, 1], [None, 1.0]), 3: ([0], [0.0])}
