"""Sinks and JSON sources (S4-S7): run-stamped table folders, CSV/parquet/JSON writers,
multi-line JSON reads. Every writer is a distributed DataFrame write into a folder
on the shared file system (the checkpoint folder's file system in tests).
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_stamp(now: _dt.datetime | None = None) -> str:
    """Run id in the reference's folder format (YYYYmmdd_HHMMSS)."""
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


def run_folder(root: str, prefix: str = "eda_output", stamp: str | None = None) -> str:
    return os.path.join(root, f"{prefix}_{stamp or run_stamp()}", "tables")


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "csv", single_file: bool = True) -> str:
    """One table per folder. Small report tables are coalesced to one file (they are
    aggregates); large tables keep their partitioning (``single_file=False``)."""
    path = os.path.join(folder, name)
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def write_tables(tables: dict, folder: str, fmt: str = "csv", row_level=()) -> DataFrame:
    """Write every table and return an index (table, path) of what was written.
    Aggregate tables are written as one file; tables named in ``row_level`` (their size
    grows with the data) keep one file per task."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = write_table(df, folder, name, fmt, single_file=name not in row_level)
        rows.append((name, path))
    idx = spark.createDataFrame(rows, "table_name string, path string")
    return idx


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multi_line).json(path)


def write_json_document(df: DataFrame, path: str) -> str:
    """A one-row frame written as one JSON document (``to_json`` of the row)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path
