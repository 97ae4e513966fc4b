"""Operators whose work must not grow with columns squared in one row, nominal bins or rows times grid."""
import numpy as np
import pytest

from churnscope.operators import plots
from churnscope.operators.correlate import correlation_blocks
from churnscope.spec import RoleSpec

ONE = RoleSpec(key="id", target="target", numeric=("x",), categorical=())


@pytest.mark.parametrize("block", [256, 64])
def test_200_columns_with_nulls_far_from_zero(spark, block):
    rng = np.random.default_rng(5)
    n, k = 600, 200
    base = rng.normal(size=(n, 8))
    x = base @ rng.normal(size=(8, k)) + rng.normal(size=(n, k)) * 0.3
    x[:, 3] = x[:, 3] + 1e9          # far from zero
    x[:, 4] = 0.1                    # constant
    x[:, 5] = -2.0 * x[:, 6] + 7.0   # exactly linear
    gone = rng.random((n, k)) < 0.1
    gone[:, 7] = np.arange(n) % 2 == 0
    gone[:, 8] = np.arange(n) % 2 == 1  # no row shared with column 7
    gone[:, 9] = True                # no value at all
    cols = [f"col.{i}" for i in range(k)]
    rows = [[None if g else float(v) for v, g in zip(r, m)] for r, m in zip(x, gone)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(7)
    got = {(r.ord_a, r.ord_b): r.r for r in correlation_blocks(df, cols, block).collect()}
    assert len(got) == k * k
    assert got[(5, 6)] == got[(6, 5)] == pytest.approx(-1.0, abs=1e-9)
    for a, b in [(0, 0), (0, 1), (2, 3), (3, 150), (63, 64), (64, 63), (199, 0), (120, 7)]:
        both = ~gone[:, a] & ~gone[:, b]
        assert got[(a, b)] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=2e-7 if 3 in (a, b) else 1e-8)
    assert got[(4, 4)] is None and got[(4, 1)] is None and got[(7, 8)] is None
    assert all(got[(9, j)] is None and got[(j, 9)] is None for j in range(k))


def test_correlation_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r.r for r in correlation_blocks(df, ["a", "b"]).collect()] == [None] * 4


def test_histogram_of_ten_bins_in_use_out_of_a_hundred_million(spark):
    used = [0, 1, 2, 65535, 65536, 65537, 40_000_000, 70_000_000, 99_999_998, 99_999_999]
    rows = [(i, float(b) + 0.5, b % 2) for i, b in enumerate(used * 3)]
    df = spark.createDataFrame(rows + [(-1, None, 0)], "id long, x double, target int")
    n = 100_000_000
    got = plots.sparse_histogram(df, ONE, fixed={"x": (0, n, n)}).collect()
    for t in (0, 1):
        mine = sorted((r for r in got if r.target == t), key=lambda r: r.bin_ord)
        assert [(r.bin_ord, r["count"]) for r in mine if r["count"]] == [(b, 3) for b in used if b % 2 == t]
        at = 0
        for r in mine:  # runs follow each other without gap or overlap
            assert r.bin_ord == at and r.bin_hi - r.bin_lo == r.run_length
            at += r.run_length
        assert at == n
        empty = [r["count"] == 0 for r in mine]
        assert not any(a and b for a, b in zip(empty, empty[1:]))  # a run is as long as can be


def test_sparse_histogram_equals_the_dense_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), int(t)) for i, (v, t) in enumerate(zip(rng.lognormal(sigma=2, size=400), rng.integers(0, 2, 400)))]
    rows += [(1000, 2.0e3, 7)]
    df = spark.createDataFrame(rows, "id long, x double, target int")
    for fixed in (None, {"x": (0, 50, 30)}):
        dense = {(r.bin_ord, r.target): r["count"] for r in plots.histogram(df, ONE, fixed=fixed).collect()}
        sparse = {}
        for r in plots.sparse_histogram(df, ONE, fixed=fixed).collect():
            sparse |= {(r.bin_ord + j, r.target): r["count"] for j in range(r.run_length)}
        assert sparse == dense


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=500), np.concatenate([rng.normal(size=500), [1e6]]), rng.integers(0, 5, 300)):
        rows = [(i, float(v), i % 2) for i, v in enumerate(values)] + [(-1, None, 0), (-2, 3.0, 9)]
        df = spark.createDataFrame(rows, "id long, x double, target int")
        want = {(r.target, r.grid_ord): (r.grid_x, r.density) for r in plots.density_curve(df, ONE).collect()}
        got = {(r.target, r.grid_ord): (r.grid_x, r.density) for r in plots.density_binned(df, ONE).collect()}
        assert got.keys() == want.keys() and {t for t, _ in got} == {0, 1}
        for t in (0, 1):
            x = np.array([r[1] for r in rows if r[2] == t and r[1] is not None])
            h = x.std(ddof=1) * len(x) ** -0.2
            bound = 1 / (8 * plots.FINE ** 2 * np.sqrt(2 * np.pi) * h) + 2e-9
            assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= bound for k in got if k[0] == t)
