"""Feature preparation: exact stratified split, population scaling, drop-first one-hot,
category metadata and balanced class weights (W5, M1-M5, A23, A25).

Fitting follows MLlib's fit/transform split: ``fit_preparation`` runs one aggregate
over the training rows (means, population deviations) plus one distinct-values query
per categorical column whose size is checked before it reaches the driver; the fitted
state is a few numbers and strings. ``transform`` is pure column expressions.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.ranking import exclusive_running_sum, global_row_number
from churnscope.session import ensure_checkpoint_dir, shuffle_partitions
from churnscope.sources.tables import literal_frame, require_columns
from churnscope.spec import SPLIT_SEED, SPLIT_TEST_SIZE, RoleSpec

MAX_CATEGORIES = 1000


# ---- W5 / M5: exact stratified split ---------------------------------------------------

def split_order(spec: RoleSpec, seed: int = SPLIT_SEED, order: str = "hash") -> Column:
    """Row order inside a stratum. 'hash': xxhash64 of (seed, key), uniform over the
    long range. 'portable': (key * 2654435761) % 1000003, reproducible in any SQL engine; the factors are
    reduced first, so no key overflows."""
    k = F.col(spec.key)
    if order == "portable":
        return ((k % F.lit(1000003)) * F.lit(2654435761 % 1000003)) % F.lit(1000003)
    return F.xxhash64(F.lit(seed), k)


def split_allocation(df: DataFrame, spec: RoleSpec, test_size: float = SPLIT_TEST_SIZE) -> DataFrame:
    """Rows per class in the test split: n_test = ceil(test_size * n); the training
    size is shared out over the classes by largest remainder and each class's test
    share is what is left of it. One row per class (computed on the class counts)."""
    return _allocated(df.groupBy(spec.target).agg(F.count(F.lit(1)).alias("n_class")), spec.target, test_size)


def _allocated(counts: DataFrame, t: str, test_size: float) -> DataFrame:
    """``split_allocation`` from (class, n_class) rows."""
    counts = counts.withColumnRenamed(t, "_cls")
    w_all = Window.partitionBy()
    total = F.sum("n_class").over(w_all)
    n_test = F.ceil(F.lit(test_size) * total)
    a = (counts.withColumn("_total", total)
         .withColumn("_n_train", F.col("_total") - n_test)
         .withColumn("_cont", F.col("n_class").cast("double") / F.col("_total") * F.col("_n_train"))
         .withColumn("_floor", F.floor("_cont"))
         .withColumn("_rem", F.col("_cont") - F.col("_floor"))
         .withColumn("_left", F.col("_n_train") - F.sum("_floor").over(w_all))
         .withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("_rem"), "_cls"))))
    train = F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)
    return a.select(F.col("_cls").alias(t), "n_class", (F.col("n_class") - train).cast("long").alias("n_test"))


def stratified_split(df: DataFrame, spec: RoleSpec, test_size: float = SPLIT_TEST_SIZE, seed: int = SPLIT_SEED,
                     order: str = "hash", n_buckets: int | None = None, unique_key: bool = True) -> DataFrame:
    """Add ``split`` ('train'/'test'): per class, the first n_test rows in the seeded
    order (ties by key) are test. Rows without a class are left out.

    No row is ranked or moved: the place of each class's last test row is found first
    (``_last_test_places``, one row per class), and every row is compared with it. The
    input is read by three passes, two of them over key and class alone; a caller that
    uses the result several times writes it itself.

    The key must be unique in a class around that place; a repeated key there ends the
    job with a message. ``unique_key=False`` is for tables where one key may hold many
    rows (even a third of them): see ``_split_by_key_groups``."""
    require_columns(df, [spec.key, spec.target], "stratified_split input")
    t = spec.target
    if not unique_key:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)  # row ids of a written input are stable
        nb = n_buckets or shuffle_partitions(df.sparkSession)
        return _split_by_key_groups(df, spec, split_allocation(df, spec, test_size), seed, order, nb)
    df = df.where(F.col(t).isNotNull())
    o = split_order(spec, seed, order)
    last = _last_test_places(df.select(t, F.struct(o.alias("ord"), F.col(spec.key).alias("key")).alias("_place")),
                             t, test_size, order)
    return (df.join(F.broadcast(last), t, "left")
            .withColumn("split", F.when(F.struct(o.alias("ord"), F.col(spec.key).alias("key")) <= F.col("_last"), "test")
                        .otherwise("train"))
            .drop("_last"))


def _last_test_places(rows: DataFrame, t: str, test_size: float, order: str) -> DataFrame:
    """(class, _last): the n_test-th smallest place of each class that has test rows.

    Places are counted in at most 2^16 bins of the (uniform) order per class; only the
    rows of the one bin that holds the n_test-th place are ranked."""
    first = F.col("_place.ord")
    # the top 16 bits of a hash; 16 neighbouring values of the portable order (a null key comes first)
    bin_ = F.shiftright(first, 48) if order == "hash" else F.coalesce(F.floor(first / 16), F.lit(-(1 << 62)))
    rows = rows.withColumn("_bin", bin_)
    hist = rows.groupBy(t, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    alloc = _allocated(hist.groupBy(t).agg(F.sum("_n").alias("n_class")), t, test_size)
    upto = F.sum("_n").over(Window.partitionBy(t).orderBy("_bin"))  # at most 2^16 rows a class
    cut = (hist.withColumn("_upto", upto).join(F.broadcast(alloc.select(t, "n_test")), t)
           .withColumn("_need", F.col("n_test") - F.col("_upto") + F.col("_n"))
           .where((F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))).select(t, "_bin", "_need"))
    w = Window.partitionBy(t).orderBy("_place")
    near = (rows.join(F.broadcast(cut), [t, "_bin"])
            .withColumn("_next", F.lead("_place").over(w)).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") == F.col("_need")))
    repeated = F.raise_error("a repeated key lies on both sides of the split: use unique_key=False")
    return near.select(t, F.when(F.col("_next") == F.col("_place"), repeated).otherwise(F.col("_place")).alias("_last"))


def _split_by_key_groups(df: DataFrame, spec: RoleSpec, alloc: DataFrame, seed: int, order: str,
                         nb: int) -> DataFrame:
    """Exact split when keys repeat. Order = (seeded key order, seeded row order), so
    the rows of a key are contiguous. Keys are counted (one row per key and class after
    map-side combine) and their starting rank is an exclusive running sum over keys;
    every key then lies wholly in test or in train, except at most one key per class
    that straddles the boundary, whose rows alone are ranked (bucketed, so even a key
    with a third of the rows is spread over tasks). Row ids come from the written input
    and are stable; with unique keys the result equals the unique-key path."""
    t, key = spec.target, spec.key
    rows = df.withColumn("_ord", split_order(spec, seed, order)).withColumn("_row", F.monotonically_increasing_id())
    keys = rows.groupBy(t, key, "_ord").agg(F.count(F.lit(1)).alias("_n"))
    before = exclusive_running_sum(keys, [t], ["_ord", key], ["_n"], nb).select(t, key, "_n", "_n_before")
    n_test = F.broadcast(alloc.select(t, "n_test"))
    j = rows.join(before, [t, key]).join(n_test, t)  # skewed keys: AQE splits the large side
    lo, hi = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    whole = (j.where((hi <= F.col("n_test")) | (lo >= F.col("n_test")))
             .withColumn("split", F.when(hi <= F.col("n_test"), "test").otherwise("train")))
    cut = j.where((lo < F.col("n_test")) & (hi > F.col("n_test")))
    cut = global_row_number(cut.withColumn("_h2", F.xxhash64(F.lit(seed), F.col(key), F.col("_row"))), [t],
                            ["_h2", "_row"], nb, out="_r")
    cut = cut.withColumn("split", F.when(lo + F.col("_r") <= F.col("n_test"), "test").otherwise("train")).drop("_h2", "_r")
    return whole.unionByName(cut).drop("_ord", "_row", "_n", "_n_before", "n_test")


# ---- A25: balanced class weights ---------------------------------------------------------------

def class_weights(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """n / (k * n_c) per class (scikit-learn 'balanced'); one row per class."""
    t = spec.target
    counts = df.groupBy(F.col(t).alias("target")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("count").over(w).cast("double") / (F.count(F.lit(1)).over(w) * F.col("count")))


def with_class_weight(df: DataFrame, spec: RoleSpec, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach the class weight (one row per class, broadcast)."""
    return df.join(F.broadcast(weights.select(F.col("target").alias(spec.target), F.col("weight").alias(out))),
                   spec.target)


# ---- M1-M4: fitted preparation ------------------------------------------------------------------

@dataclass
class Preparation:
    numeric: list
    categorical: list
    means: dict
    stds: dict
    categories: dict
    fills: dict = field(default_factory=dict)  # imputation values of columns that had nulls

    @property
    def encoded(self) -> dict:
        """Encoded column names per categorical variable (reference value dropped)."""
        return {c: [f"{c}_{v}" for v in vals[1:]] for c, vals in self.categories.items()}

    @property
    def feature_names(self) -> list:
        return list(self.numeric) + [n for c in self.categorical for n in self.encoded[c]]

    def scaled(self, c: str) -> Column:
        sd = self.stds[c] if self.stds[c] else 1.0  # sigma = 0 -> divide by 1
        return (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(sd)

    def feature_columns(self) -> list:
        cols = [self.scaled(c).alias(c) for c in self.numeric]
        for c in self.categorical:
            for v in self.categories[c][1:]:
                # unknown and reference values encode as all zeros
                cols.append(F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}"))
        return cols

    def unknown_flag(self) -> Column:
        """True when a categorical value was not seen in fitting (it encodes like the
        reference category, as in the reference; the flag makes that visible)."""
        flags = [F.col(c).isNotNull() & ~F.col(c).isin(*self.categories[c]) for c in self.categorical]
        out = F.lit(False)
        for f in flags:
            out = out | f
        return out

    def transform(self, df: DataFrame, keep=(), vector: str | None = "features", flag_unknown: bool = False) -> DataFrame:
        """Scaled numerics first, then one-hot columns; optionally a ``features`` vector
        and an ``unknown_category`` flag."""
        extra = [self.unknown_flag().alias("unknown_category")] if flag_unknown else []
        fills = {c: v for c, v in self.fills.items() if c in df.columns}
        if fills:
            df = df.fillna(fills)
        out = df.select(*keep, *self.feature_columns(), *extra)
        if vector:
            out = VectorAssembler(inputCols=self.feature_names, outputCol=vector).transform(out)
        return out

    def category_info(self, spark) -> DataFrame:
        rows = [(i, c, vals[0] if vals else None, ", ".join(vals), ", ".join(self.encoded[c]), len(vals))
                for i, (c, vals) in enumerate(self.categories.items())]
        return literal_frame(spark, rows, [("var_ord", "int"), ("variable", "string"), ("reference_category", "string"),
                                           ("all_categories", "string"), ("encoded_columns", "string"),
                                           ("n_values", "int")])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Preparation":
        return Preparation(**json.loads(text))


def distinct_values(df: DataFrame, columns, max_categories: int = MAX_CATEGORIES) -> dict:
    """Sorted distinct non-null values per column. The (variable, value) pairs are found
    by a distributed distinct; at most ``len(columns) * max_categories + 1`` rows come
    back, and a column above the bound is an error (not a silent cut)."""
    if not columns:
        return {}
    items = F.array(*[F.struct(F.lit(c).alias("v"), F.col(c).cast("string").alias("x")) for c in columns])
    pairs = (df.select(F.explode(items).alias("p")).select("p.v", "p.x")
             .where(F.col("x").isNotNull()).distinct())
    rows = pairs.limit(len(columns) * max_categories + 1).collect()
    out = {c: [] for c in columns}
    for r in rows:
        out[r.v].append(r.x)
    for c, vals in out.items():
        if len(vals) > max_categories:
            raise ValueError(f"column {c} has more than {max_categories} distinct values; not one-hot encodable")
        vals.sort()
    return out


def fit_preparation(train: DataFrame, spec: RoleSpec, max_categories: int = MAX_CATEGORIES,
                    fills: dict | None = None) -> Preparation:
    """Means and population deviations of the numeric features (one aggregate row) and
    sorted category values of the categorical ones, from the training rows only (after
    applying ``fills``, the imputation values, if any)."""
    require_columns(train, spec.features, "training rows")
    if fills:
        train = train.fillna(fills)
    aggs = []
    for c in spec.numeric:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = train.agg(*aggs).first().asDict() if aggs else {}
    means = {c: float(row[f"m_{c}"]) for c in spec.numeric}
    stds = {c: float(row[f"s_{c}"] or 0.0) for c in spec.numeric}
    cats = distinct_values(train, list(spec.categorical), max_categories)
    return Preparation(list(spec.numeric), list(spec.categorical), means, stds, cats, dict(fills or {}))
