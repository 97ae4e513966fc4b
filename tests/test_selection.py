"""Selection of ranks against numpy: wide and narrow ranges, ties, infinities, nulls, hot values, very many values."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.functions import selection

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = {"narrow": 1e6 + rng.random(3000) * 1e-6, "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-300, 300, 2000))]),
            "ties": rng.integers(-3, 4, 5000).astype(float), "one": np.array([-7.5]), "two": np.array([1.0, 2.0]), "hot": np.r_[np.full(4000, 0.1 + 0.2), rng.random(50)],
            None: rng.standard_normal(999), "tiny": np.array([5e-324, 0.0, -5e-324, 1e-310, -0.0]), "edge": np.nextafter(1.0, 2.0) ** np.arange(64), "inf": np.array([-np.inf, 1.0, np.inf])}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("one", None), ("none", None)]
    hist = spark.createDataFrame(rows, "g string, value double").groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r for r in selection.quantiles(hist, ["g"], PROBS).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        s = np.sort(x)
        for i, p in enumerate(PROBS):
            at = p * (len(s) - 1)
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            want = s[lo] if lo == hi else (hi - at) * s[lo] + (at - lo) * s[hi]
            assert got[g][f"q{i}"] == want or (np.isnan(want) and np.isnan(got[g][f"q{i}"])), (g, p)


def test_median_of_ten_million_values(spark):
    n = 10_000_000  # every k / n + 5 once, in an order of its own
    hist = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7_368_787, F.lit(n)) / n + 5).alias("value"), F.lit(1).cast("long").alias("n"))
    got = selection.quantiles(hist, ["g"], [0.5, 0.25]).first()
    assert got.q0 == 0.5 * ((n // 2 - 1) / n + 5) + 0.5 * (n // 2 / n + 5)
    assert got.q1 == pytest.approx(5.25, abs=2e-7)


def test_modes(spark):
    rows = [("a", v, n) for v, n in ((3.0, 5), (1.0, 7), (2.0, 7), (None, 99))] + [("b", None, 1)]
    assert {r.g: r.mode for r in selection.modes(spark.createDataFrame(rows, "g string, value double, n long"), ["g"]).collect()} == {"a": 1.0}


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "g string, value double, n long")
    assert selection.quantiles(none, ["g"], PROBS).count() == 0 and selection.modes(none, ["g"]).count() == 0
