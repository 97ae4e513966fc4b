"""The driver contract in __spark_entry__.py."""
import os

import duckdb

import __spark_entry__ as E
from churnscope.sources.tables import DRIVER_TABLES
from conftest import SF_SMALL


def test_entry_runs_on_the_smoke_tables(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns  # stable schema


def test_every_oracle_sql_belongs_to_a_query_and_binds_in_duckdb():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    for name, text in sql.items():
        con.execute(f"EXPLAIN {text}")  # parses and binds against the driver tables


def test_queries_return_lazy_dataframes(spark):
    from pyspark.sql import DataFrame
    qs = E.queries()
    for name in ("combined_category_churn", "roc_auc", "top_factors"):
        assert isinstance(qs[name](spark, SF_SMALL), DataFrame)
