"""Table profile, role inference, null audit and imputation (S2, S3, P3, A1-A3).

Imputation follows the fit/transform split of MLlib's ``Imputer``: the fit is one
aggregate over the table that yields a single row (one fill value per column); the
transform is ``fillna`` with those values, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.functions.selection import modes, quantiles
from churnscope.session import ensure_checkpoint_dir
from churnscope.spec import RoleSpec

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

_TYPE_NAMES = {T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "bigint",
               T.FloatType: "double", T.DoubleType: "double", T.StringType: "string", T.BooleanType: "boolean"}


def portable_type(dt: T.DataType) -> str:
    for k, v in _TYPE_NAMES.items():
        if isinstance(dt, k):
            return v
    return dt.simpleString()


def scan_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, table row count and null count.
    All counts come from a single aggregate over the table."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(F.col(c).isNull().cast("long")).alias(f"_z{i}")
                                               for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(i).alias("column_ord"), F.lit(c).alias("column_name"),
                               F.lit(portable_type(df.schema[c].dataType)).alias("data_type"),
                               F.col(f"_z{i}").alias("null_count")) for i, c in enumerate(cols)])
    return (wide.select(F.col("_n").alias("row_count"), F.explode(items).alias("c"))
            .select("c.column_ord", "c.column_name", "c.data_type", "row_count",
                    F.coalesce(F.col("c.null_count"), F.lit(0)).cast("long").alias("null_count")))


def head_rows(df: DataFrame, spec: RoleSpec, n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (top-k per partition, then a final merge)."""
    return df.orderBy(spec.key).limit(n)


def infer_roles(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Role of every column from its type: numeric -> 'numerical', string ->
    'categorical'; the spec's key and target keep their roles. With the number of values that
    aren't null, all columns in one aggregate."""
    items = []
    for i, f in enumerate(df.schema.fields):
        if f.name == spec.target:
            role = "target"
        elif f.name == spec.key:
            role = "key"
        elif isinstance(f.dataType, NUMERIC_TYPES):
            role = "numerical"
        elif isinstance(f.dataType, T.StringType):
            role = "categorical"
        else:
            role = "other"
        items.append(F.struct(F.lit(i).alias("column_ord"), F.lit(f.name).alias("column_name"),
                              F.lit(portable_type(f.dataType)).alias("data_type"), F.lit(role).alias("role"),
                              F.count(F.col(f"`{f.name}`")).alias("n_values")))
    return df.agg(F.array(*items).alias("c")).select(F.inline("c"))


def numeric_columns(df: DataFrame, exclude=()) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def null_audit(df: DataFrame) -> DataFrame:
    """Null count of every column that has nulls (one aggregate over the table)."""
    prof = scan_profile(df)
    return prof.where(F.col("null_count") > 0).select("column_ord", "column_name", "null_count")


def fit_imputer(df: DataFrame, numeric, categorical) -> dict:
    """Fill values: exact median for numeric columns, most frequent value (lowest on
    ties, 'Unknown' when the column is all null) for categorical ones: by selection and by counts
    of values, so no task holds all values of a column; one row a column comes to the driver."""
    fills: dict = {}
    if numeric:
        hist = _histogram(df, numeric, "double")
        fills |= {r.variable: r.q0 for r in quantiles(hist, ["variable"], [0.5]).collect()}  # one row a column
    if categorical:
        found = {r.variable: r.mode for r in modes(_histogram(df, categorical, "string"), ["variable"]).collect()}
        fills |= {c: found.get(c, "Unknown") for c in categorical}
    return fills


def _histogram(df: DataFrame, columns, kind: str) -> DataFrame:
    """(variable, value, n) of the columns, written once: rows are counted in their tasks before the shuffle."""
    ensure_checkpoint_dir(df.sparkSession)
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    return df.select(F.inline(items)).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def impute(df: DataFrame, fills: dict) -> DataFrame:
    """Apply fitted fill values; numeric columns become double (as pandas does when a
    median fills an integer column)."""
    out = df
    for c, v in fills.items():
        if isinstance(v, float):
            out = out.withColumn(c, F.col(c).cast("double"))
    return out.fillna(fills)


def impute_nulls(df: DataFrame, spec: RoleSpec | None = None, fit_df: DataFrame | None = None) -> DataFrame:
    """Null audit + imputation in one call. Only columns with nulls are touched (as the
    reference does); ``fit_df`` lets the fill values come from the training rows."""
    exclude = (spec.key, spec.target) if spec else ()
    audit_cols = [r.column_name for r in null_audit(df).collect()]  # one row per column with nulls
    num = [c for c in numeric_columns(df, exclude) if c in audit_cols]
    cat = [c for c in categorical_columns(df, exclude) if c in audit_cols]
    fills = fit_imputer(fit_df if fit_df is not None else df, num, cat)
    return impute(df, fills)
