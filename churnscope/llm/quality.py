"""Quality grades from an ordinal cumulative-link regression.

Graded ratings (0, 1, ...) are modelled with one weight vector over hashed words, punctuation runs
and binned shares, and ordered thresholds: P(grade >= j) = sigmoid(w.x - t_j). The expected grade
is the sum of these tail probabilities; selection takes texts by expected grade or by a tail.

Defined results as in ``toxicity``: null and empty texts are scored, null labels aren't learned
from, repeated rows are scored one by one, all columns of the input stay (names of the outputs
are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import linear
from churnscope.llm.store import bounded_batches


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, learn: Column, rows: int = linear.SAMPLE_ROWS) -> linear.Model:
    """Fit on the labelled documents; ``grade``: int column of the labels, 0 to ``grades`` - 1."""
    s = linear.labelled_sample(docs, labels, grade, learn, rows)
    return linear.fit(s.select("grade", linear.features(F.col("text"), shape=True).alias("features")), grades)


def grade(docs: DataFrame, model: linear.Model) -> DataFrame:
    """``docs`` with tails (P(grade >= 1), ...), expected_grade and grade_pred (the most likely grade)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.thresholds)
    d = docs.withColumn("tails", linear.tails(F.col("text").cast("string"), shared, shape=True))
    t = [F.lit(1.0), *[F.col("tails")[j] for j in range(k)], F.lit(0.0)]
    p = F.array(*[t[j] - t[j + 1] for j in range(k + 1)])
    return d.withColumn("expected_grade", sum(t[1:-1], F.lit(0.0))).withColumn("grade_pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))
