"""Connected components of a link table by label spreading over DataFrames.

Each round a vertex takes the smallest label among itself and its neighbours, then the label of that
label (pointer jumping), so long chains need few rounds. Every round is written to the shared folder:
no lineage grows, and nothing but one count of changes comes to the driver. A vertex with very many
links costs one row a task in the shuffle (a partial minimum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the links (a, b); label is the smallest vertex of its component."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both = written(both.distinct(), "links")
    now = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        near = both.join(now.withColumnsRenamed({"v": "u"}), "u").groupBy("v").agg(F.min("label").alias("n"))
        step = now.join(near, "v").select("v", F.least("label", "n").alias("label"), F.col("label").alias("old"))
        jump = now.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = written(step.join(jump, "label", "left").select("v", F.least("label", "far").alias("label"), "old"), "labels")
        if not new.where(F.col("label") < F.col("old")).head(1):
            return new.select("v", "label")
        now = new.select("v", "label")
