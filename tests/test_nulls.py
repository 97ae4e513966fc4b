"""Null values count in no statistic of a histogram; large keys don't overflow the portable order."""
import pytest
from pyspark.sql import functions as F

from churnscope.operators import eda, plots, prepare
from churnscope.spec import RoleSpec

SPEC = RoleSpec(key="id", target="y", numeric=("x",), categorical=())


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, 1, float(v)) for i, v in enumerate((1, 2, 2, 3, 10))] + [(10 + i, 1, None) for i in range(6)]
    return spark.createDataFrame(rows, "id long, y int, x double")


def test_outlier_summary_ignores_nulls(frame):
    r = eda.outlier_summary(frame, SPEC).first()
    assert (round(r["mean"], 9), r["mode"], r["median"]) == (3.6, 2.0, 2.0)
    assert r["outlier_percentage"] == pytest.approx(100.0 / 11)


def test_stats_from_histogram_ignore_nulls(frame):
    h = frame.select(F.lit("x").alias("variable"), F.col("y").alias("target"), F.col("x").alias("value")).groupBy("variable", "target", "value").agg(F.count(F.lit(1)).alias("n"))
    r = eda.stats_from_histogram(h).first()
    assert (r["count"], round(r["mean"], 9), r["mode"]) == (5, 3.6, 2.0)


def test_charts_ignore_nulls(frame):
    same = frame.where("x IS NOT NULL")
    assert plots.histogram(frame, SPEC).collect() == plots.histogram(same, SPEC).collect()
    assert plots.density_curve(frame, SPEC).collect() == plots.density_curve(same, SPEC).collect()


def test_portable_order_of_a_large_key(spark):
    big = spark.createDataFrame([(4_000_000_000,), (1 << 62,)], "id long")
    got = [r.o for r in big.select(prepare.split_order(SPEC, order="portable").alias("o")).collect()]
    assert got == [k * 2654435761 % 1000003 for k in (4_000_000_000, 1 << 62)]
