"""Toxicity scores from a counterfactual-regularised classifier.

Logistic regression on hashed words of labelled documents. For each labelled text that names an
identity group a counterfactual text is made by swapping every identity term for the next one of
its family; the squared difference between the two scores is penalised, so that the score can't
lean on which group is named and neutral mentions of a group aren't raised. Identity terms always have a weight, so that
the penalty acts on them; of the other words those that pass ``screen`` (see ``linear.fit``) have one.

Labels come from at most ``rows`` labelled ids (documented bound of the fit); scoring covers every
whole text.

Defined results: a null or empty text has no features and gets the score of the threshold alone;
a null label or id is not learned from; no labels at all: every score is 0.5 (predicted 1);
repeated rows are scored one by one; all columns of the input stay, those named score or
predicted are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import linear
from churnscope.llm.store import bounded_batches

#: Families of identity terms; a term is swapped for the next one of its family.
FAMILIES = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "indian", "african"),
    ("immigrant", "refugee", "foreigner"), ("immigrants", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"), ("old", "young"), ("elderly", "teenage"),
)
_NEXT = {a: f[(i + 1) % len(f)] for f in FAMILIES for i, a in enumerate(f)}
_WORD = re.compile(r"[a-z]+")
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE | re.ASCII)


def swap_identities(text: str | None) -> str | None:
    """The counterfactual text, or None if no identity term is in it."""
    if not text or _NEXT.keys().isdisjoint(_WORD.findall(text.lower())):
        return None
    return _TERM.sub(lambda m: _NEXT[m[0].lower()], text)


def _swapped(text: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([swap_identities(t) for t in a.to_pylist()], pa.string()), T.StringType())(text)


def identity_features() -> np.ndarray:
    """The feature numbers of all identity terms."""
    return np.unique(np.concatenate([f for *_, f in linear.feature_sets(pa.array(sorted(_NEXT)))]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = linear.SAMPLE_ROWS, pair: float = 1.0,
        screen: float = linear.SCREEN) -> linear.Model:
    """Fit on labelled documents (``learn``: condition on the labels' doc_id)."""
    s = linear.labelled_sample(docs, labels, F.col(label).cast("int"), learn, rows)
    s = s.withColumn("_cf", _swapped(F.col("text"))).select(
        "grade", linear.features(F.col("text")).alias("features"),
        F.when(F.col("_cf").isNotNull(), linear.features(F.col("_cf"))).alias("swapped"))
    return linear.fit(s, 2, pair=pair, centre=True, screen=screen, always=identity_features())


def score(docs: DataFrame, model: linear.Model) -> DataFrame:
    """``docs`` with score (P(toxic)) and predicted (1 from 0.5 on)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.withColumn("score", linear.tails(F.col("text").cast("string"), shared)[0])
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
