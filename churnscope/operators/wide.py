"""Categorical columns with any number of values: a written dictionary and sparse one-hot vectors (M2, M4, A23).

``prepare.fit_preparation`` keeps the values of a column on the driver and stops above ``MAX_CATEGORIES``. Here the
values of all columns stay a table: (variable, value, idx), idx counting the column's distinct values from 0 in byte
order, as the dense way sorts them. Value 0 is the reference and has no slot; slots follow each other column by column.

Fitting numbers the values without a window: they are range-partitioned by (column, value), sorted inside each
partition and written; a value's idx is its place in its partition plus the values of its column in earlier ones.

Encoding looks values up by key. A value that many rows share (known or not) would fill one task of a join by value, so
the values of at least 1/``FREQUENT`` of the rows, at most ``FREQUENT`` a column, are found first and broadcast; only
the others are shuffled by value, and none of those holds more than that share. Keys are the values themselves up to
``KEY_BYTES`` bytes and digests of longer ones, which bounds the broadcast in bytes, too.

Defined results: a null value and one that fitting didn't see have no slot (an empty vector if all are so, like the
dense way's zeros); repeated rows are rows of their own; an empty table gives an empty dictionary and no rows; columns
of the input named ``indices`` or ``values`` are replaced, the others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir, shuffle_partitions
from churnscope.sources.tables import require_columns

FREQUENT = 1024
KEY_BYTES = 64
#: MLlib's vectors have int indices
MAX_SLOTS = 2 ** 31 - 1


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _key(value: Column) -> Column:
    return F.when(F.octet_length(value) <= KEY_BYTES, value).otherwise(F.concat(F.lit("sha256:"), F.sha2(value, 256)))


def _cells(columns) -> Column:
    """array<struct<var_ord, value>> of a row's values that aren't null."""
    cells = F.array(*[F.struct(F.lit(i).alias("var_ord"), _quoted(c).cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    return F.filter(cells, lambda x: x["value"].isNotNull())


@dataclass(frozen=True)
class ValueDictionary:
    columns: tuple
    entries: DataFrame  # var_ord, value, key, idx
    sizes: tuple        # distinct values by column

    @property
    def offsets(self) -> list:
        """First slot of each column."""
        slots = [max(n - 1, 0) for n in self.sizes]
        return [sum(slots[:i]) for i in range(len(slots))]

    @property
    def size(self) -> int:
        return sum(max(n - 1, 0) for n in self.sizes)

    def slot(self, var_ord: Column, idx: Column) -> Column:
        """Slot of a value; null for the reference."""
        first = F.element_at(F.array(*[F.lit(o).cast("long") for o in self.offsets]), var_ord + 1)
        return F.when(idx > 0, first + idx - 1)

    def table(self) -> DataFrame:
        """variable, value, idx, slot and the encoded column's name."""
        name = F.element_at(F.array(*[F.lit(c) for c in self.columns]), F.col("var_ord") + 1)
        slot = self.slot(F.col("var_ord"), F.col("idx"))
        return self.entries.select(name.alias("variable"), "value", "idx", slot.alias("slot"),
                                   F.when(slot.isNotNull(), F.concat(name, F.lit("_"), F.col("value"))).alias("feature"))

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, columns) -> "ValueDictionary":
        return _sized(tuple(columns), spark.read.parquet(path))


def _sized(columns: tuple, entries: DataFrame) -> ValueDictionary:
    n = {r.var_ord: r["n"] for r in entries.groupBy("var_ord").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    return ValueDictionary(columns, entries, tuple(n.get(i, 0) for i in range(len(columns))))


def fit_dictionary(train: DataFrame, columns) -> ValueDictionary:
    """The dictionary of the columns' values in ``train``, written once to the checkpoint folder."""
    columns = tuple(columns)
    if not columns:
        raise ValueError("a value dictionary needs at least one column")
    require_columns(train, list(columns), "training rows")
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    values = train.select(F.inline(_cells(columns))).distinct()
    # the written place: partition in the upper bits, row in it in the lower 33
    placed = (values.repartitionByRange(shuffle_partitions(spark), "var_ord", "value").sortWithinPartitions("var_ord", "value")
              .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright("_at", 33)
    # ranges are contiguous, so there are at most as many of these as partitions and columns together
    runs = placed.groupBy("var_ord", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("var_ord").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    entries = (placed.withColumn("_part", part).join(F.broadcast(runs), ["var_ord", "_part"])
               .select("var_ord", "value", _key(F.col("value")).alias("key"),
                       (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx")))
    return _sized(columns, entries)


def sparse_features(df: DataFrame, d: ValueDictionary, numeric=()) -> DataFrame:
    """``df`` with ``indices`` array<long> (ascending) and ``values`` array<double>: the ``numeric`` columns first, as slots
    0, 1, ... (all of them, nulls as nulls: impute before), then 1.0 at the slots of the row's categories."""
    require_columns(df, list(d.columns), "rows to encode")
    ensure_checkpoint_dir(df.sparkSession)
    numeric = [c if isinstance(c, Column) else _quoted(c) for c in numeric]
    kept = [_quoted(c) for c in df.columns if c not in ("indices", "values")]
    k = len(numeric)
    cells = F.transform(_cells(d.columns), lambda x: F.struct(x["var_ord"].alias("var_ord"), _key(x["value"]).alias("key")))
    # row ids and repeated reads need a written copy
    rows = df.select(F.struct(*kept).alias("_row"), cells.alias("_cells"),
                     F.array(*[c.cast("double") for c in numeric]).cast("array<double>").alias("_num"),
                     F.monotonically_increasing_id().alias("_id")).checkpoint(eager=True)
    long = rows.select("_id", F.inline("_cells"))
    on = ["var_ord", "key"]
    entries = d.entries.select(*on, "idx")
    often = (long.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") * FREQUENT >= rows.count()).select(*on).checkpoint(eager=True))
    known = F.broadcast(entries.join(F.broadcast(often), on))
    found = long.join(known, on).unionByName(long.join(F.broadcast(often), on, "left_anti").join(entries, on))
    slot = d.slot(F.col("var_ord"), F.col("idx"))
    slots = (found.select("_id", (slot + k).alias("slot")).where("slot IS NOT NULL")
             .groupBy("_id").agg(F.sort_array(F.collect_list("slot")).alias("_slots")))  # at most one a column
    got = F.coalesce("_slots", F.array().cast("array<long>"))
    first = F.array(*[F.lit(i).cast("long") for i in range(k)]).cast("array<long>")
    return (rows.join(slots, "_id", "left")
            .select("_row.*", F.concat(first, got).alias("indices"),
                    F.concat("_num", F.array_repeat(F.lit(1.0), F.size(got))).alias("values")))


def ml_vectors(encoded: DataFrame, d: ValueDictionary, numeric: int = 0, out: str = "features") -> DataFrame:
    """``encoded`` with MLlib's sparse vector in place of ``indices`` and ``values``. Spark has no column function that makes
    one, so this step alone is a Python function; leave it out where no estimator follows."""
    size = d.size + numeric
    if size > MAX_SLOTS:
        raise ValueError(f"{size} slots; MLlib's vectors have at most {MAX_SLOTS}")
    make = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    return encoded.withColumn(out, make("indices", "values")).drop("indices", "values")
