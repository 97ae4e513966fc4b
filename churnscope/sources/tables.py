"""Readers for the driver's parquet tables and the reference's golden CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Column layout of the reference's input CSV (one customer per row, no key).
GOLDEN_SCHEMA = T.StructType([
    T.StructField("Ages", T.IntegerType()),
    T.StructField("FrequentFlyer", T.StringType()),
    T.StructField("AnnualIncomeClass", T.StringType()),
    T.StructField("ServicesOpted", T.IntegerType()),
    T.StructField("AccountSyncedToSocialMedia", T.StringType()),
    T.StructField("BookedHotelOrNot", T.StringType()),
    T.StructField("Target", T.IntegerType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Column pruning and filter pushdown reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass over the data)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_golden(spark: SparkSession, path: str, rename_age: bool = True) -> DataFrame:
    """The reference's 954-row table with a ``row_id`` key in file order.

    The file is one small split, so ``monotonically_increasing_id`` gives file order;
    for a large multi-file input use a key column from the source instead.
    """
    df = read_csv(spark, path, GOLDEN_SCHEMA)
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    if rename_age:
        df = rename_if_present(df, {"Ages": "Age"})
    return df


def rename_if_present(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename columns that exist and whose new name is free; others are left as is."""
    for old, new in mapping.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def select_existing(df: DataFrame, columns) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    """Fail before any job runs when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def literal_frame(spark: SparkSession, rows, columns) -> DataFrame:
    """A small table of literal rows built inside the JVM plan (``inline`` of an array
    of structs): no Python worker and no local-data transfer. ``columns`` is a list of
    (name, SQL type). For bounded metadata only (band domains, feature metadata)."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in columns))
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, columns)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
