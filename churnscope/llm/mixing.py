"""Mixing sources to target weights by Poisson replication.

Each document of source s is repeated Poisson(r_s) times, r_s = (target rows of s) / (rows of s).
The draw inverts the Poisson distribution at a uniform number that is a hash of (seed, doc_id), so
a run can be repeated row by row. The copies are shuffled globally by a hash of (seed, doc_id, copy):
the hash is uniform, so its leading part is the partition and no range sampling is needed.

DataFrame functions only. The distribution is one array per source (the sources' table is broadcast
up to ``SMALL`` sources; beyond that Spark joins it by source and splits a hot source). A rate above
``STEP`` is drawn as a sum of several independent draws, so the array stays short.

Defined results: a null source is a source of its own; a null doc_id hashes as ''; repeated rows are
drawn alike (same hash, same count); a source without a weight or with weight 0 gives no rows; an
empty table gives no rows; all columns stay (copy and shuffle_key are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.store import written

SMALL = 100_000
STEP = 300.0
SEED = 20240


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of a hash."""
    return F.conv(F.substring(_hash(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def tempered(docs: DataFrame, alpha: float = 0.5, source: str = "source") -> DataFrame:
    """(source, weight): weights in proportion to (rows of the source) ** alpha."""
    return docs.groupBy(source).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, total: int | None = None, source: str = "source") -> DataFrame:
    """(source, rate, draws, cdf): mean copies of a document, number of draws, distribution of one draw."""
    n = docs.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(source, "_s")
    w = weights.select(F.col(source).alias("_ws"), F.col("weight").cast("double").alias("_w")).where(F.col("_w") > 0)
    r = n.join(w, F.col("_s").eqNullSafe(F.col("_ws")))
    all_w = r.agg(F.sum("_w")).scalar()
    rows = F.lit(float(total)) if total is not None else r.agg(F.sum("_n").cast("double")).scalar()
    r = r.select(F.col("_s").alias(source), (F.col("_w") / all_w * rows / F.col("_n")).alias("rate"))
    r = r.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int")))
    lam = F.col("rate") / F.col("draws")
    top = F.ceil(lam + 12 * F.sqrt(lam) + 30).cast("int")
    empty = F.array().cast("array<double>")
    # running sums of the probabilities of 0, 1, 2, ... copies
    cdf = F.aggregate(F.sequence(F.lit(1), top),
                      F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.array_append(empty, F.exp(-lam)).alias("all")),
                      lambda a, k: F.struct((a["p"] * lam / k).alias("p"), (a["c"] + a["p"] * lam / k).alias("c"),
                                            F.array_append(a["all"], a["c"] + a["p"] * lam / k).alias("all")),
                      lambda a: a["all"])
    return r.withColumn("cdf", cdf)


def copies(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` repeated by their draws, with copy (from 1) and shuffle_key, not yet shuffled."""
    r = written(rates(docs, weights, total, source).withColumnsRenamed({source: "_s", "rate": "_rate", "draws": "_draws", "cdf": "_cdf"}), "rates")
    n = r.count()
    d = docs.join(F.broadcast(r) if n <= SMALL else r, F.col(source).eqNullSafe(F.col("_s")))
    # the hashes are bound as lambda variables, so each is computed once, not once for each step of the distribution
    hashes = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: uniform(seed, F.col(key), i))
    count = F.aggregate(hashes, F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: c <= u)))
    d = d.withColumn("_copies", count).where(F.col("_copies") > 0)
    d = d.drop("copy", "shuffle_key", *r.columns).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return d.withColumn("shuffle_key", F.substring(_hash(seed, F.col(key), F.lit("copy"), F.col("copy")), 1, 16)).drop("_copies")


def shuffled(d: DataFrame, partitions: int | None = None) -> DataFrame:
    """Global order by shuffle_key (uniform hexadecimal digits): its leading part is the partition."""
    n = partitions or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))).cast("int")
    return d.repartitionById(n, part).sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed and globally shuffled rows; by default as many as there are documents (in the mean)."""
    return shuffled(copies(docs, weights, total, seed, source, key))
