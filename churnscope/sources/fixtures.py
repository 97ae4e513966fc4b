"""Fixture views over the driver tables.

Each view exists twice: as DataFrame code (what the Spark queries read) and as SQL
text (what the DuckDB oracle reads). Both describe the same rows; the SQL text is
only ever handed to the oracle, never parsed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.operators.explain import linear_contributions, long_contributions
from churnscope.sources.tables import read_table

CUTOFF = "2000-08-01 00:00:00"
RECENT_FROM = "2000-02-01 00:00:00"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def churn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: six churn features from orders before the cut-off, and
    ``target`` = 1 when the customer placed no order on or after it.

    Orders are reduced per customer first (partial aggregation on the map side, so a
    customer with a third of all orders costs one row per map task), then joined to
    the customer table on the key both sides are partitioned by.
    """
    d = F.col("o_orderdate")
    before = d < _ts(CUTOFF)
    per_cust = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.when(before, 1).otherwise(0)).alias("n_before"),
            F.sum(F.when((d >= _ts(RECENT_FROM)) & before, 1).otherwise(0)).alias("n_recent"),
            F.sum(F.when(~before, 1).otherwise(0)).alias("n_after"),
            F.max(F.when(before & (F.col("o_orderpriority") == "1-URGENT"), 1).otherwise(0)).alias("urgent"),
            F.max(F.when(before & (F.col("o_orderstatus") == "P"), 1).otherwise(0)).alias("pending"),
        )
    )
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    n_before = F.coalesce(F.col("n_before"), F.lit(0))
    bal = F.col("c_acctbal")
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        (F.lit(20) + F.col("c_custkey") % 41).cast("int").alias("age"),
        F.when(n_before == 0, "No Record").when(n_before >= 10, "Yes").otherwise("No").alias("frequent_buyer"),
        F.when(bal < 2000, "Low Income").when(bal < 6000, "Middle Income").otherwise("High Income").alias("income_class"),
        F.least(F.lit(6), F.lit(1) + F.coalesce(F.col("n_recent"), F.lit(0))).cast("int").alias("services"),
        F.when(F.coalesce(F.col("urgent"), F.lit(0)) == 1, "Yes").otherwise("No").alias("has_urgent"),
        F.when(F.coalesce(F.col("pending"), F.lit(0)) == 1, "Yes").otherwise("No").alias("has_pending"),
        F.when(F.coalesce(F.col("n_after"), F.lit(0)) == 0, 1).otherwise(0).alias("target"),
    )


def line_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its supplier region and order priority; target = returned.

    nation and region have a fixed size (25 and 5 rows by the TPC-H rules) and are
    broadcast. supplier grows with the scale factor: Spark broadcasts it only while
    its measured size stays under ``spark.sql.autoBroadcastJoinThreshold`` (AQE
    re-checks at run time) and uses a shuffle join beyond that.
    """
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supp_region = (
        read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("supplier_region"))
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus", "l_suppkey", "l_returnflag")
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(supp_region, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_linenumber",
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_linestatus").alias("line_status"),
            "supplier_region",
            F.col("o_orderpriority").alias("priority"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"),
        )
    )


def line_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_returns`` reduced to (line_status, supplier_region, priority) with row
    count n, sum s and sum of squares s2 of the target, and count z of target 0.

    Eager aggregation: after the order join, line items are grouped by (supplier,
    status, priority) with map-side partial aggregation, so the supplier join shuffles
    at most one row per supplier and category pair per task instead of every line
    item. Exact: inner-join multiplicities carry through the sums.
    """
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supp_region = (
        read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("supplier_region"))
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag")
    t = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    pre = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .groupBy(F.col("l_suppkey"), F.col("l_linestatus").alias("line_status"),
                    F.col("o_orderpriority").alias("priority"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("s2"),
                F.sum(1 - t).alias("z")))
    return (pre.join(supp_region, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("line_status", "supplier_region", "priority", "n", "s", "s2", "z"))


def line_value_histogram(spark: SparkSession, sf_dir: str, columns=("quantity", "discount"),
                         by_target: bool = False) -> DataFrame:
    """(variable, value, n) over ``line_returns`` for its numeric columns, aggregated
    eagerly: after the order join (a semi join here: the order's columns are not
    needed), line items are grouped by (supplier, variable, value) with grouping sets
    and map-side combine, so the supplier join sees at most one row per supplier and
    distinct value per task. Exact: the supplier join's multiplicity carries through n.
    """
    exprs = {"quantity": F.col("l_quantity").cast("int").cast("double"), "discount": F.col("l_discount").cast("double")}
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey")
    supp = (read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount",
                                                      "l_returnflag")
    kept = li.join(orders, li.l_orderkey == orders.o_orderkey, "left_semi")
    items = F.array(*[F.struct(F.lit(c).alias("variable"), exprs[c].alias("value")) for c in columns])
    keys = ["variable", "target", "value"] if by_target else ["variable", "value"]
    t = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target")
    long = kept.select("l_suppkey", t, F.explode(items).alias("u")).select("l_suppkey", "target", "u.variable", "u.value")
    pre = long.groupBy("l_suppkey", *keys).agg(F.count(F.lit(1)).alias("n"))
    return (pre.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(*keys).agg(F.sum("n").alias("n")))


def score_expr(df: DataFrame) -> Column:
    """The integer-point scorecard of the ``scored`` view (no exp: exact in any engine)."""
    pts = (
        F.lit(30)
        + F.when(F.col("frequent_buyer") == "Yes", 20).when(F.col("frequent_buyer") == "No Record", 5).otherwise(0)
        + F.when(F.col("income_class") == "Low Income", -5).when(F.col("income_class") == "Middle Income", -15).otherwise(0)
        + F.lit(6) * F.col("services")
        - F.when(F.col("has_urgent") == "Yes", 8).otherwise(0)
        - F.when(F.col("has_pending") == "Yes", 12).otherwise(0)
        + F.abs(F.col("age") - 40).cast("int")
    )
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), pts / F.lit(100).cast("double")))


def scored(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    cf = features if features is not None else churn_features(spark, sf_dir)
    return cf.select("customer_id", "target", score_expr(cf).alias("score"))


# (model_ord, model, shift) of the four score variants.
MODEL_VARIANTS = ((1, "card_base", 0.0), (2, "card_low", -0.125), (3, "card_high", 0.125), (4, "card_top", 0.25))


def model_scores(spark: SparkSession, sf_dir: str, scored_df: DataFrame | None = None) -> DataFrame:
    """Four score variants per customer, generated per row (explode), not by a join."""
    s = scored_df if scored_df is not None else scored(spark, sf_dir)
    variants = F.array(*[
        F.struct(F.lit(o).alias("model_ord"), F.lit(m).alias("model"), F.lit(sh).cast("double").alias("shift"))
        for o, m, sh in MODEL_VARIANTS
    ])
    return (
        s.select("*", F.explode(variants).alias("m"))
        .select(
            F.col("m.model").alias("model"), F.col("m.model_ord").alias("model_ord"), "customer_id", "target",
            F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("score") + F.col("m.shift"))).alias("score"),
        )
    )


def raw_records(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    """Text records with bad values planted by key: not a number, null, out of range,
    unknown category and blank."""
    cf = features if features is not None else churn_features(spark, sf_dir)
    k = F.col("customer_id")
    return cf.select(
        "customer_id",
        F.when(k % 13 == 0, "abc").when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 0, "140").otherwise(F.col("age").cast("string")).alias("age"),
        F.when(k % 23 == 0, "Maybe").otherwise(F.col("frequent_buyer")).alias("frequent_buyer"),
        F.when(k % 29 == 0, "  ").otherwise(F.col("income_class")).alias("income_class"),
        F.when(k % 31 == 0, "9").otherwise(F.col("services").cast("string")).alias("services"),
        "has_urgent", "has_pending",
    )


def with_nulls(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    cf = features if features is not None else churn_features(spark, sf_dir)
    k = F.col("customer_id")
    return cf.select(
        "customer_id",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("age")).cast("int").alias("age"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("income_class")).cast("string").alias("income_class"),
        F.lit(None).cast("string").alias("all_null"),
        "services", "target",
    )


# Fixed linear weights of the ``attributions`` view: (feature, value expression, weight).
ATTRIBUTION_WEIGHTS = (
    ("age", None, -0.005),
    ("services", None, 0.06),
    ("frequent_buyer_No Record", ("frequent_buyer", "No Record"), 0.05),
    ("frequent_buyer_Yes", ("frequent_buyer", "Yes"), 0.2),
    ("income_class_Low Income", ("income_class", "Low Income"), -0.05),
    ("income_class_Middle Income", ("income_class", "Middle Income"), -0.15),
    ("has_urgent_Yes", ("has_urgent", "Yes"), -0.08),
    ("has_pending_Yes", ("has_pending", "Yes"), -0.12),
)


def attribution_terms() -> list:
    """(feature, value expression, weight) of the ``attributions`` view."""
    return [(name, F.col(name) if ind is None else F.when(F.col(ind[0]) == ind[1], 1.0).otherwise(0.0), w)
            for name, ind, w in ATTRIBUTION_WEIGHTS]


def attribution_rows(spark: SparkSession, sf_dir: str, features: DataFrame | None = None, keep=()) -> DataFrame:
    """One row per customer: the array of linear attributions w·(x − mean x), as this view
    defines them rounded to 6 digits."""
    cf = features if features is not None else churn_features(spark, sf_dir)
    rows = linear_contributions(cf, "customer_id", attribution_terms(), keep=keep)
    return rows.withColumn("contributions", F.transform("contributions", lambda c: F.struct(
        c["feature"].alias("feature"), F.round(c["contribution"], 6).alias("contribution"))))


def attributions(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    """The same, one row per customer and feature."""
    return long_contributions(attribution_rows(spark, sf_dir, features), "customer_id")


# ---------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracle only.
# ---------------------------------------------------------------------------
VIEW_SQL = {
    "churn_features": """
WITH o AS (
  SELECT o_custkey,
         SUM(CASE WHEN o_orderdate <  TIMESTAMP '2000-08-01 00:00:00' THEN 1 ELSE 0 END) AS n_before,
         SUM(CASE WHEN o_orderdate >= TIMESTAMP '2000-02-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-08-01 00:00:00' THEN 1 ELSE 0 END) AS n_recent,
         SUM(CASE WHEN o_orderdate >= TIMESTAMP '2000-08-01 00:00:00' THEN 1 ELSE 0 END) AS n_after,
         MAX(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01 00:00:00' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
         MAX(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01 00:00:00' AND o_orderstatus = 'P' THEN 1 ELSE 0 END) AS pending
  FROM orders GROUP BY o_custkey)
SELECT c.c_custkey AS customer_id,
       CAST(20 + c.c_custkey % 41 AS INT) AS age,
       CASE WHEN COALESCE(o.n_before,0) = 0 THEN 'No Record' WHEN o.n_before >= 10 THEN 'Yes' ELSE 'No' END AS frequent_buyer,
       CASE WHEN c.c_acctbal < 2000 THEN 'Low Income' WHEN c.c_acctbal < 6000 THEN 'Middle Income' ELSE 'High Income' END AS income_class,
       CAST(LEAST(6, 1 + COALESCE(o.n_recent,0)) AS INT) AS services,
       CASE WHEN COALESCE(o.urgent,0) = 1 THEN 'Yes' ELSE 'No' END AS has_urgent,
       CASE WHEN COALESCE(o.pending,0) = 1 THEN 'Yes' ELSE 'No' END AS has_pending,
       CASE WHEN COALESCE(o.n_after,0) = 0 THEN 1 ELSE 0 END AS target
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey""",
    "line_returns": """
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_quantity AS INT) AS quantity, l.l_discount AS discount,
       l.l_linestatus AS line_status, r.r_name AS supplier_region, o.o_orderpriority AS priority,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS target
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "scored": """
SELECT customer_id, target,
       LEAST(0.99, GREATEST(0.01, (
         30 + CASE frequent_buyer WHEN 'Yes' THEN 20 WHEN 'No Record' THEN 5 ELSE 0 END
            + CASE income_class WHEN 'Low Income' THEN -5 WHEN 'Middle Income' THEN -15 ELSE 0 END
            + 6 * services
            - CASE WHEN has_urgent = 'Yes' THEN 8 ELSE 0 END
            - CASE WHEN has_pending = 'Yes' THEN 12 ELSE 0 END
            + CAST(ABS(age - 40) AS INT)) / CAST(100 AS DOUBLE))) AS score
FROM churn_features""",
    "model_scores": """
SELECT m.model, m.model_ord, s.customer_id, s.target, LEAST(0.99, GREATEST(0.01, s.score + m.shift)) AS score
FROM scored s CROSS JOIN (
  SELECT 1 AS model_ord, 'card_base' AS model, CAST(0.0 AS DOUBLE) AS shift UNION ALL
  SELECT 2, 'card_low', CAST(-0.125 AS DOUBLE) UNION ALL
  SELECT 3, 'card_high', CAST(0.125 AS DOUBLE) UNION ALL
  SELECT 4, 'card_top', CAST(0.25 AS DOUBLE)) m""",
    "raw_records": """
SELECT customer_id,
       CASE WHEN customer_id % 13 = 0 THEN 'abc' WHEN customer_id % 17 = 0 THEN NULL WHEN customer_id % 19 = 0 THEN '140' ELSE CAST(age AS VARCHAR(10)) END AS age,
       CASE WHEN customer_id % 23 = 0 THEN 'Maybe' ELSE frequent_buyer END AS frequent_buyer,
       CASE WHEN customer_id % 29 = 0 THEN '  ' ELSE income_class END AS income_class,
       CASE WHEN customer_id % 31 = 0 THEN '9' ELSE CAST(services AS VARCHAR(10)) END AS services,
       has_urgent, has_pending
FROM churn_features""",
    "with_nulls": """
SELECT customer_id,
       CASE WHEN customer_id % 11 = 0 THEN NULL ELSE age END AS age,
       CASE WHEN customer_id % 7 = 0 THEN NULL ELSE income_class END AS income_class,
       CAST(NULL AS VARCHAR(10)) AS all_null, services, target
FROM churn_features""",
    "attributions": """
WITH long AS (
  SELECT customer_id, 'age' AS feature, CAST(age AS DOUBLE) AS x, CAST(-0.005 AS DOUBLE) AS w FROM churn_features UNION ALL
  SELECT customer_id, 'services', CAST(services AS DOUBLE), CAST(0.06 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'frequent_buyer_No Record', CAST(CASE WHEN frequent_buyer = 'No Record' THEN 1 ELSE 0 END AS DOUBLE), CAST(0.05 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'frequent_buyer_Yes', CAST(CASE WHEN frequent_buyer = 'Yes' THEN 1 ELSE 0 END AS DOUBLE), CAST(0.2 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'income_class_Low Income', CAST(CASE WHEN income_class = 'Low Income' THEN 1 ELSE 0 END AS DOUBLE), CAST(-0.05 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'income_class_Middle Income', CAST(CASE WHEN income_class = 'Middle Income' THEN 1 ELSE 0 END AS DOUBLE), CAST(-0.15 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'has_urgent_Yes', CAST(CASE WHEN has_urgent = 'Yes' THEN 1 ELSE 0 END AS DOUBLE), CAST(-0.08 AS DOUBLE) FROM churn_features UNION ALL
  SELECT customer_id, 'has_pending_Yes', CAST(CASE WHEN has_pending = 'Yes' THEN 1 ELSE 0 END AS DOUBLE), CAST(-0.12 AS DOUBLE) FROM churn_features)
SELECT customer_id, feature, ROUND(w * (x - AVG(x) OVER (PARTITION BY feature)), 6) AS contribution FROM long""",
}

VIEW_SQL["churn_split"] = """
WITH cnt AS (SELECT target, COUNT(*) AS n_class FROM churn_features GROUP BY target),
a AS (SELECT target, n_class, SUM(n_class) OVER () AS total FROM cnt),
b AS (SELECT *, total - CEIL(CAST(0.2 AS DOUBLE) * total) AS n_train FROM a),
c AS (SELECT *, CAST(n_class AS DOUBLE) / total * n_train AS cont FROM b),
d AS (SELECT *, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem FROM c),
e AS (SELECT *, n_train - SUM(fl) OVER () AS lft, ROW_NUMBER() OVER (ORDER BY rem DESC, target) AS rk FROM d),
alloc AS (SELECT target, n_class - (fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END) AS n_test FROM e),
r AS (SELECT customer_id, target,
             ROW_NUMBER() OVER (PARTITION BY target ORDER BY ((customer_id % 1000003) * 427799) % 1000003, customer_id) AS rnk
      FROM churn_features)
SELECT r.customer_id, r.target, CASE WHEN r.rnk <= alloc.n_test THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc ON r.target = alloc.target"""

VIEW_DEPS = {
    "churn_split": ("churn_features",),
    "churn_features": (),
    "line_returns": (),
    "scored": ("churn_features",),
    "model_scores": ("scored",),
    "raw_records": ("churn_features",),
    "with_nulls": ("churn_features",),
    "attributions": ("churn_features",),
}


def _closure(views) -> list:
    out: list = []

    def visit(v):
        for d in VIEW_DEPS[v]:
            visit(d)
        if v not in out:
            out.append(v)

    for v in views:
        visit(v)
    return out


def sql_with(views, body: str) -> str:
    """Oracle SQL: the named fixture views (and what they read) as CTEs, then ``body``."""
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in _closure(views))
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
