"""Attribution tables: linear attribution, global importance, signed direction, the
business interpretation table, per-record factor lists and their totals
(X1, X6-X12, A31-A33, A36, W1, W3, T1, T3, T4, J2, J3).

Attributions are a long table ``(key, feature, contribution)``, one row per record and
feature, or one row per record with the array ``contributions``. Per-feature results are
aggregates over the long table (partial + final, one row per feature); per-record results
are expressions on the array, without a shuffle; a long table is first grouped by the
record key, whose groups hold one row per feature (bounded by the feature count). Feature metadata (type, parent variable,
reference category, display names, glossary) is one small row per feature, built
from the fitted category values and broadcast.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.functions import texts as TX
from churnscope.functions.stats import stable
from churnscope.sources.tables import literal_frame
from churnscope.spec import RoleSpec

META_SCHEMA = ("feature_ord int, feature string, feature_type string, variable string, value string, "
               "reference_category string, analog_variable string, interpretable_name string, "
               "simplified_name string, business_interpretation string, business_meaning string")


def _vs_value(text: str):
    m = re.search(r"\(vs (.+)\)$", text)
    return m.group(1) if m else None


def display_name(analog_variable: str, value: str, values: list, ref: str) -> str:
    """Friendly name of an encoded column: the fixed display name when its comparison
    is consistent with the data's reference category, else '<variable>: <value> (vs <ref>)'."""
    fixed = TX.DISPLAY_FEATURE.get(f"{analog_variable}_{value}")
    vs = _vs_value(fixed) if fixed else None
    if fixed and not (vs is not None and vs in values and vs != ref):
        return fixed
    base = TX.DISPLAY_VARIABLE.get(analog_variable, analog_variable)
    return f"{base}: {value} (vs {ref})"


def feature_rows(spec: RoleSpec, categories: dict) -> list:
    """Per-feature metadata rows (numeric features first, then each categorical
    variable's non-reference values in sorted order, the one-hot layout)."""
    rows = []
    for c in spec.numeric:
        a = spec.analog.get(c, c)
        rows.append([c, "numerical", c, None, None, a, c, TX.DISPLAY_NUMERIC.get(a, c), f"{c} (numerical value)",
                     TX.GLOSSARY.get(a, TX.GLOSSARY_DEFAULT)])
    for c in spec.categorical:
        vals = categories[c]
        ref = vals[0] if vals else None  # an all-null column has no encoded columns
        a = spec.analog.get(c, c)
        for v in vals[1:]:
            rows.append([f"{c}_{v}", "categorical", c, v, ref, a, f"{c}: {v} vs {ref}", display_name(a, v, vals, ref),
                         f"When {c} is '{v}' (vs '{ref}')", TX.GLOSSARY.get(a, TX.GLOSSARY_DEFAULT)])
    return [tuple([i] + r) for i, r in enumerate(rows)]


def feature_metadata(spark: SparkSession, spec: RoleSpec, categories: dict) -> DataFrame:
    return literal_frame(spark, feature_rows(spec, categories),
                         [tuple(c.strip().split(" ", 1)) for c in META_SCHEMA.split(",")])


# ---- X1 / X12: linear attribution -------------------------------------------------------------

def linear_contributions(df: DataFrame, key: str, terms, background: DataFrame | None = None,
                         keep=()) -> DataFrame:
    """phi_j = w_j (x_j - mean_background(x_j)) in margin space, as the array ``contributions``
    of (feature, contribution) beside the record's key and the columns ``keep``. The background
    means are one row of one aggregate (a scalar subquery); sum_j phi_j + base equals the
    record's margin, base = intercept + sum_j w_j mean_j."""
    bg = background if background is not None else df
    means = bg.agg(F.array(*[F.avg(x.cast("double")) for _, x, _ in terms]).alias("means")).scalar()
    items = [F.struct(F.lit(n).alias("feature"),
                      (F.lit(float(w)) * (x.cast("double") - F.get("_means", F.lit(i)))).alias("contribution"))
             for i, (n, x, w) in enumerate(terms)]
    return df.withColumn("_means", means).select(key, *keep, F.array(*items).alias("contributions"))


def long_contributions(rows: DataFrame, key: str) -> DataFrame:
    """(key, feature, contribution) of an array of contributions."""
    return rows.select(key, F.inline("contributions"))


def record_contributions(attr: DataFrame, key: str) -> DataFrame:
    """One row per record with its array ``contributions``; a long table is grouped by the key."""
    if "contributions" in attr.columns:
        return attr
    pairs = F.collect_list(F.struct("feature", "contribution"))  # as many as there are features
    return attr.groupBy(key).agg(F.array_sort(pairs).alias("contributions"))


def linear_base(background: DataFrame, terms, intercept: float = 0.0) -> DataFrame:
    """Expected value of the margin over the background (one row; null without rows), of the terms
    of ``linear_contributions``."""
    means = [F.avg(x.cast("double")) * float(w) for _, x, w in terms]
    return background.agg(F.count(F.lit(1)).alias("n_background"),
                          functools.reduce(Column.__add__, means, F.lit(float(intercept))).alias("expected_value"))


# ---- A31 / A36 / W1 / T1 / X6: global importance ------------------------------------------------

def global_importance(attr: DataFrame) -> DataFrame:
    """Mean |contribution| per feature, its share of the total in %, rank 1..F
    (importance desc, feature name on ties)."""
    # means are rounded to STAT_DIGITS before ranking: the order must not hinge on
    # summation-order bits
    per = attr.groupBy("feature").agg(stable(F.avg(F.abs("contribution"))).alias("shap_importance"))
    # one row per feature from here on (bounded by the feature count)
    w_all = Window.partitionBy()
    share = stable(F.try_divide(F.col("shap_importance"), F.sum("shap_importance").over(w_all)) * 100.0)
    return (per.withColumn("shap_importance_normalized", share)
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("shap_importance"), "feature"))))


# ---- A32: signed mean and direction -----------------------------------------------------------------

def impact_direction(attr: DataFrame) -> DataFrame:
    """Signed mean contribution; 'increases churn' above eps, 'reduces churn' below
    -eps, else neutral, with eps = max(1e-6, 1% of the largest |mean|)."""
    per = attr.groupBy("feature").agg(stable(F.avg("contribution")).alias("mean_shap"))
    eps = F.greatest(F.lit(1e-6), F.max(F.abs("mean_shap")).over(Window.partitionBy()) * 0.01)
    m = F.col("mean_shap")
    direction = F.when(m > eps, TX.DIRECTION_UP).when(m < -eps, TX.DIRECTION_DOWN).otherwise(TX.DIRECTION_NEUTRAL)
    return per.withColumn("impact_direction", direction)


# ---- X8: rule-based action -----------------------------------------------------------------------------

def recommended_action(name: Column, direction: Column) -> Column:
    """First rule whose name part is in the (reference-named) feature decides."""
    up = direction == TX.DIRECTION_UP
    down = direction == TX.DIRECTION_DOWN
    svc, ffl, inc, soc, hotel, age = TX.ACTION_RULES
    has = name.contains
    return (
        F.when(has(svc[0]) & up, svc[1]).when(has(svc[0]) & down, svc[2])
        .when(has(ffl[0]), F.when(up, ffl[1]).otherwise(ffl[2]))
        .when(has(inc[0]), F.when(has("Low"), inc[1]).otherwise(inc[2]))
        .when(has(soc[0]), F.when(up, soc[1]).otherwise(soc[2]))
        .when(has(hotel[0]), F.when(up, hotel[1]).otherwise(hotel[2]))
        .when(has(age[0]), F.when(up, age[1]).otherwise(age[2]))
        .when(up, TX.ACTION_FALLBACK_UP).when(down, TX.ACTION_FALLBACK_DOWN).otherwise(F.lit(""))
    )


def analog_feature(meta_alias: str = "") -> Column:
    """The feature's name written with the reference's variable names."""
    p = f"{meta_alias}." if meta_alias else ""
    return F.when(F.col(f"{p}feature_type") == "numerical", F.col(f"{p}analog_variable")) \
        .otherwise(F.concat(F.col(f"{p}analog_variable"), F.lit("_"), F.col(f"{p}value")))


# ---- X7: business interpretation -----------------------------------------------------------------------------

def business_interpretation(attr: DataFrame, meta: DataFrame) -> DataFrame:
    """Importance, direction, metadata and action per feature, joined by feature name
    (the reference matched the signed means by position after sorting; repaired)."""
    imp = global_importance(attr)
    dirn = impact_direction(attr)
    m = F.broadcast(meta)
    j = imp.join(dirn, "feature").join(m, "feature", "left")
    return j.select(
        "rank", "feature",
        F.coalesce(F.col("feature_type"), F.lit("numerical")).alias("feature_type"),
        F.coalesce(F.col("business_interpretation"), F.concat(F.col("feature"), F.lit(" (numerical value)")))
        .alias("business_interpretation"),
        F.coalesce(F.col("business_meaning"), F.lit(TX.GLOSSARY_DEFAULT)).alias("business_meaning"),
        "impact_direction", "mean_shap", "shap_importance", "shap_importance_normalized",
        F.col("shap_importance_normalized").alias("confidence_pct"),
        recommended_action(F.coalesce(analog_feature(), F.col("feature")), F.col("impact_direction"))
        .alias("recommended_action"),
    )


# ---- X11 / W3 / R7: per-record factor list -------------------------------------------------------------------

def factor_lists(attr: DataFrame, meta: DataFrame, key: str = "customer_id", k: int = TX.TOP_FACTORS) -> DataFrame:
    """Per record the array ``factors``: contributions by |value| desc (feature order on ties), first
    k, with rank, display name and direction; other columns of the record stay. The metadata, one
    entry per feature, is a scalar subquery."""
    entry = F.struct("feature", F.struct("feature_ord", "simplified_name").alias("m"))
    names = meta.agg(F.map_from_entries(F.collect_list(entry)).alias("names")).scalar()
    rows = record_contributions(attr, key).withColumn("_names", names)

    def named(c: Column) -> Column:
        m = F.try_element_at("_names", c["feature"])
        size = F.coalesce(F.abs(c["contribution"]), F.lit(-1.0))
        return F.struct((-size).alias("order"), m["feature_ord"].alias("ord"), c["feature"].alias("feature"),
                        m["simplified_name"].alias("name"), c["contribution"].alias("contribution"))

    def ranked(x: Column, i: Column) -> Column:
        c = x["contribution"]
        return F.struct((i + 1).cast("int").alias("factor_rank"), x["feature"].alias("feature"),
                        F.coalesce(x["name"], x["feature"]).alias("simplified_name"), c.alias("contribution"),
                        F.abs(c).alias("abs_contribution"),
                        F.when(c > 0, "increases").otherwise("decreases").alias("direction"))

    first = F.slice(F.array_sort(F.transform("contributions", named)), 1, k)
    return rows.withColumn("factors", F.transform(first, ranked)).drop("_names")


def top_factors(attr: DataFrame, meta: DataFrame, key: str = "customer_id", k: int = TX.TOP_FACTORS) -> DataFrame:
    """The factor lists as rows: one per record and factor."""
    return factor_lists(attr, meta, key, k).select(key, F.inline("factors"))


# ---- A33: per-record totals ------------------------------------------------------------------------------------

def contrib_split(attr: DataFrame, key: str = "customer_id") -> DataFrame:
    """Sum of positive and of negative contributions per record (0 when none)."""
    return record_contributions(attr, key).select(key, *[c.alias(n) for n, c in contribution_totals().items()])


def contribution_totals() -> dict:
    """The columns of ``contrib_split`` from the array ``contributions``."""
    def side(test):
        return F.filter(F.transform("contributions", lambda c: c["contribution"]), test)

    up, down = side(lambda c: c > 0), side(lambda c: c < 0)
    return {"total_positive": total(up), "total_negative": total(down),
            "n_increasing": F.size(up).cast("long"), "n_decreasing": F.size(down).cast("long")}


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 when empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# ---- T3 / T4: head-k lists -------------------------------------------------------------------------------------

def top_features(importance: DataFrame, k: int, group_cols=(), order_col: str = "shap_importance") -> DataFrame:
    """First k features by importance per group (one row per feature and group)."""
    w = Window.partitionBy(*group_cols).orderBy(F.desc(order_col), "feature")
    return importance.withColumn("top_rank", F.row_number().over(w)).where(F.col("top_rank") <= k)


def dependence_list(attr: DataFrame, k: int = 4) -> DataFrame:
    """File names of the dependence plots of the k most important features (name
    cleaned of ' ', '/' and ':'); the reference indexed the sorted table with unsorted
    positions here, repaired."""
    imp = global_importance(attr)
    return (top_features(imp, k).select(
        F.col("top_rank").alias("plot_rank"), "feature",
        F.concat(F.lit("shap_dependence_"), F.translate("feature", " /:", "___"), F.lit(".png")).alias("file_name")))
