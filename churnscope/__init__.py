"""churnscope: churn analytics built from Spark DataFrame, SQL and MLlib operators.

Layout
------
sources/    table readers, fixture views over the driver tables, sinks
functions/  column-expression helpers (binning, statistics, text, ranking)
operators/  the analytics: profile, eda, plots, prepare, evaluate, models, explain, rules
plans/      the query registry (Spark query + equivalent SQL per operator)
streaming/  the Structured Streaming scorer
"""

from churnscope.spec import RoleSpec, CHURN_SPEC, GOLDEN_SPEC  # noqa: F401

__all__ = ["RoleSpec", "CHURN_SPEC", "GOLDEN_SPEC"]
