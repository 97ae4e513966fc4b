"""Randomised checks (hypothesis) of the exact distributed building blocks against
plain Python on small inputs."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnscope.operators import evaluate, prepare
from churnscope.spec import RoleSpec

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _approximate_mode(counts, n_draws):
    """Largest-remainder allocation (ties to the smaller class), in plain Python."""
    total = sum(counts.values())
    cont = {k: v / total * n_draws for k, v in counts.items()}
    floor = {k: math.floor(c) for k, c in cont.items()}
    left = n_draws - sum(floor.values())
    for k in sorted(counts, key=lambda k: (-(cont[k] - floor[k]), k))[:left]:
        floor[k] += 1
    return floor


@SETTINGS
@given(st.dictionaries(st.integers(0, 3), st.integers(1, 60), min_size=1, max_size=4))
def test_split_allocation_matches_largest_remainder(spark, counts):
    rows = [(i, k) for k, n in counts.items() for i in range(n)]
    df = spark.createDataFrame([(j, k) for j, (_, k) in enumerate(rows)], "id int, target int")
    spec = RoleSpec(key="id", target="target", numeric=(), categorical=())
    got = {r.target: r.n_test for r in prepare.split_allocation(df, spec).collect()}
    n = len(rows)
    n_test = math.ceil(0.2 * n)
    train = _approximate_mode(counts, n - n_test)
    assert got == {k: counts[k] - train[k] for k in counts}
    assert sum(got.values()) == n_test


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=80))
def test_auc_matches_pair_count(spark, data):
    df = spark.createDataFrame([(y, s / 8.0) for y, s in data], "target int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    got = evaluate.roc_auc(df, n_buckets=3, materialize=False).first().roc_auc
    if len({s for _, s in data}) <= 1:
        assert got == 0.5
    elif not pos or not neg:
        assert got is None
    else:
        want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
        assert abs(got - want) < 1e-12


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=1, max_size=60))
def test_confusion_from_histogram_matches_rows(spark, data):
    df = spark.createDataFrame([(y, s / 4.0) for y, s in data], "target int, score double")
    hist = evaluate.score_histogram(df, materialize=False)
    got = evaluate.confusion_from_histogram(hist).first()
    pred = [(y, 1 if s / 4.0 > 0.5 else 0) for y, s in data]
    want = (sum(1 for y, p in pred if y == 0 and p == 0), sum(1 for y, p in pred if y == 0 and p == 1),
            sum(1 for y, p in pred if y == 1 and p == 0), sum(1 for y, p in pred if y == 1 and p == 1))
    assert (got.tn, got.fp, got.fn, got.tp) == want
    rows = evaluate.confusion(df.withColumn("predicted", evaluate.predict_at(F.col("score")))).first()
    assert (rows.tn, rows.fp, rows.fn, rows.tp) == want
