"""Scoring rules: record validation, impact strength, factor explanations, key
takeaways and recommendations (P13-P15, R3-R10, J6, F1-F14).

All rules are column expressions (``when`` chains, ``contains`` lookups, array
building and slicing); per-record lists are built from the record's own factor rows
(grouped by the record key, at most ``TOP_FACTORS`` rows per group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions import texts as TX
from churnscope.functions.stats import stable
from churnscope.operators.explain import total
from churnscope.sources.tables import require_columns
from churnscope.spec import SIGNIFICANT_FACTOR, RoleSpec


def _nonnull_array(items) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# ---- P13 / P14 / P15: validation --------------------------------------------------------------

def validate_records(raw: DataFrame, spec: RoleSpec, fields=None, extra=()) -> DataFrame:
    """Check text records: every field present and non-blank, age a whole number in
    18..100, services in 1..6, the flyer field one of its three values. All errors are
    listed in check order; ``first_error`` is what a one-error check would report.
    Columns named in ``extra`` are kept."""
    by_ref = {spec.analog.get(c, c): c for c in spec.features}
    fields = list(fields or [by_ref.get(r, r) for r in TX.REQUIRED_FIELDS])
    # a missing column is a contract error before any job runs; a missing value is a
    # per-record error reported in the output
    require_columns(raw, [spec.key] + fields, "scoring records")
    age_c, svc_c, ffl_c = by_ref.get("Ages"), by_ref.get("ServicesOpted"), by_ref.get("FrequentFlyer")
    errs = []
    for f in fields:
        v = F.col(f)
        errs.append(F.when(v.isNull(), F.lit(f"Missing field: {f}"))
                    .when(F.trim(v.cast("string")) == "", F.lit(f"{f} is empty")))

    def present(c):
        return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")

    age_i = F.expr(f"try_cast(`{age_c}` AS INT)")
    svc_i = F.expr(f"try_cast(`{svc_c}` AS INT)")
    errs.append(F.when(present(age_c) & (age_i.isNull() | (age_i < TX.AGE_MIN) | (age_i > TX.AGE_MAX)),
                       F.lit(f"{age_c} must be between {TX.AGE_MIN} and {TX.AGE_MAX}")))
    errs.append(F.when(present(svc_c) & (svc_i.isNull() | (svc_i < TX.SERVICES_MIN) | (svc_i > TX.SERVICES_MAX)),
                       F.lit(f"{svc_c} must be between {TX.SERVICES_MIN} and {TX.SERVICES_MAX}")))
    errs.append(F.when(present(ffl_c) & ~F.col(ffl_c).isin(*TX.FLYER_VALUES),
                       F.lit(f"{ffl_c} must be Yes, No, or No Record")))
    arr = _nonnull_array(errs)
    return raw.select(
        spec.key, *fields, *extra,
        age_i.alias(f"{age_c}_int"), svc_i.alias(f"{svc_c}_int"),
        (F.size(arr) == 0).alias("is_valid"), F.size(arr).alias("n_errors"),
        F.get(arr, 0).alias("first_error"), F.array_join(arr, "; ").alias("errors"))


# ---- P20: factor rows from alternative layouts ------------------------------------------------------

def factor_arrays(top: DataFrame, key: str) -> DataFrame:
    """One row per record with its array ``factors`` in rank order; factor rows are grouped by the key."""
    if "factors" in top.columns:
        return top
    others = [c for c in top.columns if c not in (key, "factor_rank")]
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("factor_rank", *others))).alias("factors"))


def normalize_factors(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Accept factors (rows, or the records' arrays) under the alternative field names the scoring
    page accepts (name / display_name / value / explanation): the first present field wins, then a
    default."""
    lists = "factors" in df.columns
    names = df.schema["factors"].dataType.elementType.names if lists else df.columns

    def fields(get) -> list:
        def pick(options, default):
            present = [get(n) for n in options if n in names]
            return F.coalesce(*present, default) if present else default

        contribution = pick(["contribution", "value"], F.lit(0.0)).cast("double")
        return [pick(["factor_rank"], F.lit(None).cast("int")).alias("factor_rank"),
                pick(["feature", "name"], F.lit("unknown")).alias("feature"),
                pick(["simplified_name", "display_name", "feature"], F.lit("unknown")).alias("simplified_name"),
                contribution.alias("contribution"),
                pick(["abs_contribution"], F.abs(contribution)).alias("abs_contribution"),
                pick(["reason", "explanation"], F.lit("")).alias("reason")]

    if lists:
        return df.withColumn("factors", F.transform("factors", lambda x: F.struct(*fields(lambda n: x[n]))))
    return df.select(key, *fields(F.col))


# ---- R8: impact strength ---------------------------------------------------------------------------

def impact_strength(abs_c: Column) -> Column:
    e = None
    for th, lab in TX.IMPACT_LEVELS:
        e = F.when(abs_c > th, lab) if e is None else e.when(abs_c > th, lab)
    return e.otherwise(TX.IMPACT_DEFAULT)


# ---- R9 / J6: explanation text, first contained key wins ----------------------------------------------

def factor_text(name: Column, contribution: Column, risk: bool) -> Column:
    low = F.lower(name)
    e = None
    for key, risk_text, prot_text in TX.EXPLANATIONS:
        if risk and key == "age":
            text = F.when(contribution > TX.AGE_SIGNIFICANT, TX.RISK_TEXT_AGE_SIG).otherwise(TX.RISK_TEXT_AGE)
        else:
            text = F.lit(risk_text if risk else prot_text)
        cond = low.contains(key)
        e = F.when(cond, text) if e is None else e.when(cond, text)
    return e.otherwise(TX.RISK_TEXT_DEFAULT if risk else TX.PROTECTIVE_TEXT_DEFAULT)


def factor_explanations(top: DataFrame, key: str = "customer_id", per_side: int = TX.FACTORS_PER_SIDE) -> DataFrame:
    """Risk-increasing (> 0) and protective (< 0) factors of each record, at most
    ``per_side`` each in list order, with strength and explanation."""
    def explained(side: str, test, risk: bool) -> Column:
        return F.transform(F.slice(F.filter("factors", test), 1, per_side), lambda x, i: F.struct(
            F.lit(side).alias("side"), (i + 1).cast("int").alias("side_rank"), x["feature"].alias("feature"),
            x["simplified_name"].alias("simplified_name"), x["contribution"].alias("contribution"),
            impact_strength(x["abs_contribution"]).alias("impact_strength"),
            factor_text(x["simplified_name"], x["contribution"], risk).alias("explanation")))

    both = F.concat(explained("increasing", lambda x: x["contribution"] > 0, True),
                    explained("decreasing", lambda x: x["contribution"] < 0, False))
    return factor_arrays(top, key).select(key, F.inline(both))


# ---- R10: key takeaways -----------------------------------------------------------------------------------

def key_takeaways(top: DataFrame, key: str = "customer_id") -> DataFrame:
    """Up to five takeaways per record from its factor list; a record without factors has no row."""
    up, down = F.filter("factors", lambda x: x["contribution"] > 0), F.filter("factors", lambda x: x["contribution"] < 0)
    size = F.filter("factors", lambda x: x["abs_contribution"] > SIGNIFICANT_FACTOR)
    per = factor_arrays(top, key).where(F.size("factors") > 0).select(
        key, stable(total(F.transform(up, lambda x: x["abs_contribution"]))).alias("total_risk"),
        stable(total(F.transform(down, lambda x: F.abs(x["contribution"])))).alias("total_protection"),
        F.get(up, F.lit(0)).alias("_top_risk"), F.get(down, F.lit(0)).alias("_top_prot"),
        F.size(size).cast("long").alias("n_significant"),
        F.size(up).cast("long").alias("n_increasing"), F.size(down).cast("long").alias("n_decreasing"))
    risk, prot = F.col("total_risk"), F.col("total_protection")
    balance = (F.when(risk > prot * TX.TAKEAWAY_RATIO, TX.TAKEAWAY_RISKY)
               .when(prot > risk * TX.TAKEAWAY_RATIO, TX.TAKEAWAY_PROTECTED).otherwise(TX.TAKEAWAY_BALANCED))
    items = [
        balance,
        F.when(F.col("_top_risk").isNotNull(),
               F.format_string(TX.TAKEAWAY_PRIMARY_RISK.replace("{}", "%s"), F.col("_top_risk.simplified_name"))),
        F.when(F.col("_top_prot").isNotNull(),
               F.format_string(TX.TAKEAWAY_KEY_STRENGTH.replace("{}", "%s"), F.col("_top_prot.simplified_name"))),
        F.when(F.col("n_significant") > TX.TAKEAWAY_MANY,
               F.format_string(TX.TAKEAWAY_MULTIPLE.replace("{}", "%d"), F.col("n_significant"))),
        F.when(F.col("n_increasing") > F.col("n_decreasing"), TX.TAKEAWAY_FOCUS_RISK).otherwise(TX.TAKEAWAY_FOCUS_STRENGTH),
    ]
    arr = F.slice(_nonnull_array(items), 1, TX.MAX_TAKEAWAYS)
    return per.select(key, "total_risk", "total_protection", "n_significant", F.size(arr).alias("n_takeaways"),
                      F.array_join(arr, " | ").alias("takeaways"))


# ---- R3 / R4 / R5: recommendations ---------------------------------------------------------------------------

def attribute_recommendations(spec: RoleSpec) -> Column:
    """Recommendations from the record's own attributes, in the reference's order.
    Age and services of 0 or null add nothing (falsy), as in the reference."""
    by_ref = {spec.analog.get(c, c): c for c in spec.features}
    age = F.col(by_ref["Ages"])
    inc = F.col(by_ref["AnnualIncomeClass"])
    svc = F.col(by_ref["ServicesOpted"])
    ffl = F.col(by_ref["FrequentFlyer"])
    soc = F.col(by_ref["AccountSyncedToSocialMedia"])
    hot = F.col(by_ref["BookedHotelOrNot"])
    truthy_age = age.isNotNull() & (age != 0)
    truthy_svc = svc.isNotNull() & (svc != 0)
    inc_rec = None
    for k, v in TX.REC_INCOME.items():
        inc_rec = F.when(inc == k, v) if inc_rec is None else inc_rec.when(inc == k, v)
    ffl_rec = None
    for k, v in TX.REC_FLYER.items():
        ffl_rec = F.when(ffl == k, v) if ffl_rec is None else ffl_rec.when(ffl == k, v)
    return F.array(
        F.when(truthy_age & (age < TX.AGE_YOUNG_BELOW), TX.REC_AGE_YOUNG)
        .when(truthy_age & (age > TX.AGE_SENIOR_ABOVE), TX.REC_AGE_SENIOR),
        inc_rec,
        F.when(truthy_svc & (svc <= TX.SERVICES_LOW_MAX), TX.REC_SERVICES_LOW)
        .when(truthy_svc & (svc >= TX.SERVICES_HIGH_MIN), TX.REC_SERVICES_HIGH),
        ffl_rec,
        F.when(soc == "Yes", TX.REC_SOCIAL_YES).otherwise(TX.REC_SOCIAL_NO),
        F.when(hot == "Yes", TX.REC_HOTEL_YES).otherwise(TX.REC_HOTEL_NO),
    )


def factor_recommendation(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(low.contains("age"), TX.REC_FACTOR_AGE)
            .when(low.contains("income") & low.contains("low"), TX.REC_FACTOR_INCOME_LOW)
            .when(low.contains("service"), TX.REC_FACTOR_SERVICE))


def recommendations(features: DataFrame, scores: DataFrame | None, top: DataFrame | None, spec: RoleSpec,
                    score_col: str = "score", max_items: int = TX.MAX_RECOMMENDATIONS, keep=()) -> DataFrame:
    """Risk tier, base action and up to ``max_items`` specific recommendations per
    record: attribute rules first, then rules on the top-3 factors, in that order.
    Without ``scores`` or ``top`` the features have the score or the factor lists themselves, and
    nothing is joined. Columns named in ``keep`` stay."""
    from churnscope.operators.evaluate import risk_columns

    key = spec.key
    j = features
    if scores is not None:
        j = j.join(scores.select(key, score_col), key)
    if top is not None:
        j = j.join(factor_arrays(top, key).select(key, "factors"), key, "left")
    from_top = F.transform(F.filter("factors", lambda x: x["factor_rank"] <= TX.FACTOR_RECS_FROM),
                           lambda x: factor_recommendation(x["simplified_name"]))
    facs = F.coalesce(F.filter(from_top, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    attr = F.filter(attribute_recommendations(spec), lambda x: x.isNotNull())
    recs = F.slice(F.concat(attr, facs), 1, max_items)
    level, _color, action, _alert = risk_columns(F.col(score_col))
    return j.select(key, F.col(score_col).alias("probability"), level, action,
                    F.size(recs).alias("n_recommendations"), F.array_join(recs, " | ").alias("recommendations"), *keep)
