"""Keyed permutations are bijections, differ by key, and pair rows about evenly."""
import pytest
from pyspark.sql import functions as F

from churnscope.functions.permute import keyed_permutation


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 4096, 10_007])
def test_every_repeat_is_a_bijection(spark, n):
    reps = 3
    df = spark.range(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("to", keyed_permutation(F.col("id"), n, F.col("rep"), 42))
    got = df.groupBy("rep").agg(F.countDistinct("to").alias("d"), F.min("to").alias("lo"), F.max("to").alias("hi")).collect()
    assert len(got) == reps and all((r.d, r.lo, r.hi) == (n, 0, n - 1) for r in got)
    if n > 50:
        rows = {(r.rep, r.id): r.to for r in df.collect()}
        same = sum(rows[0, i] == rows[1, i] for i in range(n)) + sum(rows[0, i] == i for i in range(n))
        assert same < 20  # about one each if the permutations are random
        assert abs(sum(rows[0, i] > n / 2 for i in range(n // 2)) - n / 4) < 4 * n ** 0.5
