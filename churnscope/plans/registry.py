"""Query registry: name -> (Spark query, equivalent oracle SQL or None).

A Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the driver
tables. The SQL text (for DuckDB, tables pre-registered as views) is only handed to
the oracle; ``None`` marks operators that are not SQL-expressible (fitted models,
seeded sampling), which get a row-count check plus their own property tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple = ()


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, operators: tuple = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so its ``register`` calls run."""
    from churnscope.plans import (  # noqa: F401
        eda_queries, evaluate_queries, explain_queries, model_queries, plot_queries, prepare_queries,
        profile_queries, report_queries, rule_queries,
    )
    return REGISTRY
