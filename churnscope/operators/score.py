"""Batch scoring of customer records (R12, R13, S14): validate, prepare, score, explain,
tier and recommend, with the reference's response layout as a nested struct / JSON.

The same function serves the batch query and every micro-batch of the streaming
scorer, so stream output equals batch output by construction.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.operators.evaluate import risk_columns
from churnscope.operators.explain import contribution_totals, factor_lists, feature_metadata, record_contributions
from churnscope.operators.models import Benchmark, background_rows, positive_probability, shapley_attribution
from churnscope.operators.rules import recommendations, validate_records
from churnscope.session import ensure_checkpoint_dir

RESPONSE_COLUMNS = ("customer_id", "is_valid", "errors", "probability", "predicted_class", "risk_level",
                    "recommendation", "n_recommendations", "recommendations", "unknown_category", "response_json",
                    "scored_at")

RECORD = "_record"


def typed_records(checked: DataFrame, spec) -> DataFrame:
    """Valid records with numeric fields as integers."""
    by_ref = {spec.analog.get(c, c): c for c in spec.features}
    age_c, svc_c = by_ref["Ages"], by_ref["ServicesOpted"]
    cols = []
    for c in spec.features:
        if c == age_c:
            cols.append(F.col(f"{age_c}_int").alias(c))
        elif c == svc_c:
            cols.append(F.col(f"{svc_c}_int").alias(c))
        else:
            cols.append(F.col(c))
    return checked.where("is_valid").select(spec.key, *cols)


def score_records(raw: DataFrame, bench: Benchmark, model_name: str, model_accuracy: float | None = None,
                  background: list | None = None, materialize: bool = True, keep=None) -> DataFrame:
    """One output row per input record; invalid records carry their errors and no score.

    The checked records and the attributions (the expensive step) each feed several branches of the
    output; with ``materialize`` both are written once to the checkpoint folder, the attributions as
    one array a record, so nothing is recomputed. The score, the factor lists, totals, recommendations
    and the response are expressions on the record and its array, which one join by the record's id
    brings together. ``keep(frame, name)`` writes both elsewhere instead, where the caller can drop them."""
    outer = bench.spec.key
    if background is None:
        background = background_rows(bench)
    # a record is known by its own id, not by its customer: one customer may send many records,
    # and a malformed line has no customer at all
    raw = raw.withColumn(RECORD, F.struct(F.col(outer).alias("key"), F.monotonically_increasing_id().alias("record")))
    bench = replace(bench, spec=replace(bench.spec, key=RECORD))
    spec, key = bench.spec, RECORD
    spark = raw.sparkSession
    checked = validate_records(raw, spec).repartition(key)
    if keep is None:
        ensure_checkpoint_dir(spark)
        keep = (lambda df, _name: df.checkpoint(eager=True)) if materialize else (lambda df, _name: df)
    checked = keep(checked, "records")
    good = typed_records(checked, spec)
    feats = bench.prep.transform(good, keep=[key, *[F.col(c).alias(f"_{c}") for c in spec.features]], flag_unknown=True)
    attr = record_contributions(shapley_attribution(bench, model_name, rows=feats, background=background), key)
    attr = keep(attr, "attributions")
    meta = feature_metadata(spark, spec, bench.prep.categories)
    scored = positive_probability(bench.models[model_name], feats).select(
        key, F.col("probability_1").alias("score"), "unknown_category", *[F.col(f"_{c}").alias(c) for c in spec.features])
    # a record's columns ride along in the factor lists' rows
    rows = factor_lists(scored.join(attr, key, "left"), meta, key)
    p = F.col("probability")
    _level, color, _action, _alert = risk_columns(p)
    body = (recommendations(rows, None, None, spec, keep=("contributions", "factors", "unknown_category", *spec.features))
            .withColumns(contribution_totals())
            .withColumn("predicted_class", (p > 0.5).cast("int"))
            .withColumn("risk_color", color))
    by_ref = {spec.analog.get(c, c): c for c in spec.features}
    response = F.struct(
        F.lit(True).alias("success"),
        F.struct(*[F.col(by_ref[r]).alias(n) for r, n in (
            ("Ages", "age"), ("FrequentFlyer", "frequent_flyer"), ("AnnualIncomeClass", "income_class"),
            ("ServicesOpted", "services_opted"), ("AccountSyncedToSocialMedia", "social_sync"),
            ("BookedHotelOrNot", "booked_hotel"))]).alias("customer"),
        F.struct(p.alias("probability"), F.col("predicted_class"), F.col("risk_level"), F.col("risk_color"),
                 F.col("recommendation")).alias("prediction"),
        F.split(F.col("recommendations"), r" \| ").alias("recommendations"),
        F.struct(F.transform("factors", lambda c: c.dropFields("factor_rank")).alias("contributions"),
                 F.col("total_positive"), F.col("total_negative"), F.lit(True).alias("available")).alias("shap"),
        F.struct(F.lit(model_name).alias("name"), F.lit(model_accuracy).cast("double").alias("accuracy"))
        .alias("model_info"))
    scored_rows = body.select(key, "probability", "predicted_class", "risk_level", "recommendation",
                              "n_recommendations", "recommendations", "unknown_category",
                              F.to_json(response).alias("response_json"))
    # the response time stamp is kept out of the JSON body so that equal inputs give
    # equal bodies (batch = stream); ISO text as the reference returns it
    return (checked.select(key, "is_valid", "errors").join(scored_rows, key, "left")
            .withColumn("scored_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .select(F.col(f"{key}.key").alias(outer), *RESPONSE_COLUMNS[1:]))

