"""Preparation queries (W5/M5, M1-M4, A23, A25) over ``churn_features``."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions.stats import stable
from churnscope.operators import prepare, wide
from churnscope.operators.eda import unpivot_columns
from churnscope.plans.registry import register
from churnscope.plans.sqltext import long_sql
from churnscope.sources.fixtures import CUTOFF, churn_features, sql_with
from churnscope.sources.tables import read_table
from churnscope.spec import CHURN_SPEC

S = CHURN_SPEC
V = ["churn_features", "churn_split"]


def split_frame(spark, sf_dir):
    """churn_features with the portable-order split (SQL-reproducible)."""
    return prepare.stratified_split(churn_features(spark, sf_dir), S, order="portable")


def fitted(spark, sf_dir):
    df = split_frame(spark, sf_dir).checkpoint(eager=True)  # read by several passes of the fit
    return df, prepare.fit_preparation(df.where(F.col("split") == "train"), S)


@register("stratified_split", sql_with(V, "SELECT * FROM churn_split"), ("W5", "M5"))
def q_stratified_split(spark, sf_dir):
    return split_frame(spark, sf_dir).select("customer_id", "target", "split")


@register("class_weights", sql_with(V, """
WITH c AS (SELECT target, COUNT(*) AS count FROM churn_split WHERE split = 'train' GROUP BY target)
SELECT target, count, CAST(SUM(count) OVER () AS DOUBLE) / (COUNT(*) OVER () * count) AS weight FROM c"""), ("A25",))
def q_class_weights(spark, sf_dir):
    df = split_frame(spark, sf_dir)
    return prepare.class_weights(df.where(F.col("split") == "train"), S)


_TRAIN = """j AS (SELECT c.*, s.split FROM churn_features c JOIN churn_split s ON c.customer_id = s.customer_id),
st AS (SELECT AVG(CAST(age AS DOUBLE)) AS ma, STDDEV_POP(CAST(age AS DOUBLE)) AS sa,
              AVG(CAST(services AS DOUBLE)) AS ms, STDDEV_POP(CAST(services AS DOUBLE)) AS ss FROM j WHERE split = 'train')"""

_SCALED = """ROUND((age - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 9) AS age,
       ROUND((services - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END, 9) AS services"""


@register("scaled_features", sql_with(V, f"""
WITH {_TRAIN}
SELECT customer_id, split, {_SCALED} FROM j, st"""), ("M1",))
def q_scaled_features(spark, sf_dir):
    df, prep = fitted(spark, sf_dir)
    return df.select("customer_id", "split", *[stable(prep.scaled(c)).alias(c) for c in S.numeric])


_CATS = f"""lt AS ({long_sql('j', S.categorical, ('customer_id', 'split'), 'VARCHAR')}),
cats AS (SELECT variable, value, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY value) AS vo
         FROM (SELECT DISTINCT variable, value FROM lt WHERE split = 'train' AND value IS NOT NULL))"""


@register("one_hot", sql_with(V, f"""
WITH {_TRAIN}, {_CATS}
SELECT l.customer_id, c.variable || '_' || c.value AS feature, CAST(CASE WHEN l.value = c.value THEN 1.0 ELSE 0.0 END AS DOUBLE) AS x
FROM lt l JOIN cats c ON l.variable = c.variable WHERE c.vo > 1"""), ("M2",))
def q_one_hot(spark, sf_dir):
    df, prep = fitted(spark, sf_dir)
    wide = prep.transform(df, keep=["customer_id"], vector=None)
    enc = [n for c in prep.categorical for n in prep.encoded[c]]
    return unpivot_columns(wide, enc, ["customer_id"], "double", var="feature", val="x")


@register("feature_matrix", sql_with(V, f"""
WITH {_TRAIN}, {_CATS},
num AS (SELECT customer_id, split, {_SCALED} FROM j, st)
SELECT customer_id, split, 'age' AS feature, 0 AS feature_ord, age AS x FROM num UNION ALL
SELECT customer_id, split, 'services', 1, services FROM num UNION ALL
SELECT l.customer_id, l.split, c.variable || '_' || c.value,
       1 + CAST(DENSE_RANK() OVER (ORDER BY CASE c.variable WHEN 'frequent_buyer' THEN 0 WHEN 'income_class' THEN 1
                                  WHEN 'has_urgent' THEN 2 ELSE 3 END, c.value) AS INTEGER),
       CASE WHEN l.value = c.value THEN 1.0 ELSE 0.0 END
FROM lt l JOIN cats c ON l.variable = c.variable WHERE c.vo > 1"""), ("M3",))
def q_feature_matrix(spark, sf_dir):
    df, prep = fitted(spark, sf_dir)
    wide = prep.transform(df, keep=["customer_id", "split"], vector=None)
    names = prep.feature_names
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("feature_ord"),
                               (stable(F.col(f"`{n}`")) if n in S.numeric else F.col(f"`{n}`")).alias("x"))
                      for i, n in enumerate(names)])
    return (wide.select("customer_id", "split", F.explode(items).alias("f"))
            .select("customer_id", "split", "f.feature", "f.feature_ord", "f.x"))


@register("category_info", sql_with(V, f"""
WITH {_TRAIN}, {_CATS}
SELECT CASE variable WHEN 'frequent_buyer' THEN 0 WHEN 'income_class' THEN 1 WHEN 'has_urgent' THEN 2 ELSE 3 END AS var_ord,
       variable, MIN(value) AS reference_category, string_agg(value, ', ' ORDER BY value) AS all_categories,
       COALESCE(string_agg(CASE WHEN vo > 1 THEN variable || '_' || value END, ', ' ORDER BY value), '') AS encoded_columns,
       CAST(COUNT(*) AS INTEGER) AS n_values
FROM cats GROUP BY variable"""), ("A23", "M4", "F5", "F7"))
def q_category_info(spark, sf_dir):
    _, prep = fitted(spark, sf_dir)
    return prep.category_info(spark)


# ---- columns with any number of values: orders by customer, priority and status ------------------

_WIDE = ("customer", "priority", "status")


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def _order_values(spark, sf_dir):
    """The dictionary is fitted on the orders before the cut-off; later ones have customers that it doesn't know."""
    df = _orders(spark, sf_dir)
    return df, wide.fit_dictionary(df.where(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")), _WIDE)


_DICTIONARY = f"""WITH cells AS (
SELECT o_orderkey, o_orderdate, 0 AS var_ord, 'customer' AS variable, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL
SELECT o_orderkey, o_orderdate, 1, 'priority', o_orderpriority FROM orders UNION ALL
SELECT o_orderkey, o_orderdate, 2, 'status', o_orderstatus FROM orders),
seen AS (SELECT DISTINCT var_ord, variable, value FROM cells WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND value IS NOT NULL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY var_ord ORDER BY value) - 1 AS idx FROM seen),
sizes AS (SELECT var_ord, COUNT(*) - 1 AS n FROM ranked GROUP BY var_ord),
firsts AS (SELECT var_ord, COALESCE(SUM(n) OVER (ORDER BY var_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sizes),
dict AS (SELECT r.*, CASE WHEN idx > 0 THEN CAST(first + idx - 1 AS BIGINT) END AS slot FROM ranked r JOIN firsts f ON r.var_ord = f.var_ord)
"""


@register("value_dictionary", _DICTIONARY + """SELECT variable, value, CAST(idx AS BIGINT) AS idx, slot,
CASE WHEN slot IS NOT NULL THEN variable || '_' || value END AS feature FROM dict""", ("A23", "M4"))
def q_value_dictionary(spark, sf_dir):
    return _order_values(spark, sf_dir)[1].table()


@register("sparse_one_hot", _DICTIONARY + """SELECT c.o_orderkey, COUNT(d.slot) AS n_slots,
COALESCE(string_agg(CAST(d.slot AS VARCHAR), ',' ORDER BY d.slot), '') AS slots
FROM cells c LEFT JOIN dict d ON c.var_ord = d.var_ord AND c.value = d.value GROUP BY c.o_orderkey""", ("M2", "M3"))
def q_sparse_one_hot(spark, sf_dir):
    df, d = _order_values(spark, sf_dir)
    out = wide.sparse_features(df.select("o_orderkey", *_WIDE), d)
    return out.select("o_orderkey", F.size("indices").cast("long").alias("n_slots"),
                      F.array_join(F.col("indices").cast("array<string>"), ",").alias("slots"))
