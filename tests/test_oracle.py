"""Every SQL-expressible query equals its DuckDB oracle on the driver's tables."""
import os

import duckdb
import pytest

from churnscope.plans.registry import load_all
from churnscope.sources.tables import DRIVER_TABLES
from conftest import SF_SMALL
from helpers import assert_same

REG = load_all()
SQL_QUERIES = sorted(n for n, q in REG.items() if q.sql is not None)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    assert_same(q.run(spark, SF_SMALL).toPandas(), duck.execute(q.sql).df())


def test_every_query_is_registered_with_operators():
    for name, q in REG.items():
        assert q.operators, f"{name} names no operator of the survey"
