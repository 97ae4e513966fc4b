"""Classification evaluation: confusion matrix, accuracy/precision/recall/F1, ROC-AUC,
per-class report, model ranking and selection (A26-A30, M14, T5-T7).

Every metric is an aggregate grouped by ``group_cols`` (e.g. the model name), so one
scan evaluates any number of models. ROC-AUC is the Mann-Whitney statistic over the
score histogram; the running count of lower-scored negatives comes from
``exclusive_running_sum`` (range buckets + offsets), so no model's scores are ever
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.ranking import exclusive_running_sum
from churnscope.functions.stats import count_where
from churnscope.session import ensure_checkpoint_dir, shuffle_partitions

THRESHOLD = 0.5


def predict_at(score: Column, threshold: float = THRESHOLD) -> Column:
    """Class 1 when the probability is strictly above the threshold."""
    return (score > F.lit(threshold)).cast("int")


def _safe_div(num: Column, den: Column) -> Column:
    """zero_division = 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def confusion(df: DataFrame, group_cols=(), label: str = "target", pred: str = "predicted") -> DataFrame:
    """tn, fp, fn, tp per group (one pass, map-side combined)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*group_cols).agg(
        count_where((y == 0) & (p == 0)).alias("tn"), count_where((y == 0) & (p == 1)).alias("fp"),
        count_where((y == 1) & (p == 0)).alias("fn"), count_where((y == 1) & (p == 1)).alias("tp"))


def confusion_table(cm: DataFrame, group_cols=()) -> DataFrame:
    """The confusion counts as the 2 x 2 table of the reference's output (rows = actual
    class, columns = predicted class)."""
    rows = F.array(
        F.struct(F.lit("Actual Negative").alias("actual"), F.lit(0).alias("row_ord"),
                 F.col("tn").alias("predicted_negative"), F.col("fp").alias("predicted_positive")),
        F.struct(F.lit("Actual Positive").alias("actual"), F.lit(1).alias("row_ord"),
                 F.col("fn").alias("predicted_negative"), F.col("tp").alias("predicted_positive")))
    return cm.select(*group_cols, F.explode(rows).alias("r")).select(*group_cols, "r.*")


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    return cm.select("*", _safe_div(tp + tn, n).alias("accuracy"), precision.alias("precision"),
                     recall.alias("recall"), f1.alias("f1"), n.alias("n_samples"))


def classification_metrics(df: DataFrame, group_cols=(), label: str = "target", pred: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 (zero_division = 0), support and the confusion
    counts per group."""
    return metrics_from_confusion(confusion(df, group_cols, label, pred))


def score_histogram(df: DataFrame, group_cols=(), label: str = "target", score: str = "score",
                    materialize: bool = True) -> DataFrame:
    """(group..., score, pos, neg): positives and negatives per distinct score, one pass
    over the scored rows. Both the confusion matrix at any threshold and the AUC are
    functions of it. With ``materialize`` it is written once to the checkpoint folder
    (it feeds several passes: bounds, bucket totals, running sums, confusion)."""
    y = F.col(label)
    hist = df.groupBy(*group_cols, score).agg(count_where(y == 1).alias("pos"), count_where(y == 0).alias("neg"))
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        hist = hist.checkpoint(eager=True)
    return hist


def auc_from_histogram(hist: DataFrame, group_cols=(), score: str = "score", n_buckets: int | None = None) -> DataFrame:
    gc = list(group_cols)
    nb = n_buckets or shuffle_partitions(hist.sparkSession)
    run = exclusive_running_sum(hist, gc, score, ["neg"], nb)
    pairs = F.col("pos").cast("double") * (F.col("neg_before").cast("double") + 0.5 * F.col("neg"))
    agg = run.groupBy(*gc).agg(F.sum(pairs).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                               F.count(F.lit(1)).alias("n_scores"))
    auc = (F.when(F.col("n_scores") <= 1, F.lit(0.5))
           .when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double"))
           .otherwise(F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))))
    return agg.select(*gc, auc.alias("roc_auc"), F.col("n_pos").cast("long").alias("n_pos"),
                      F.col("n_neg").cast("long").alias("n_neg"))


def confusion_from_histogram(hist: DataFrame, group_cols=(), score: str = "score",
                             threshold: float = THRESHOLD) -> DataFrame:
    above = F.col(score) > F.lit(threshold)
    return hist.groupBy(*group_cols).agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("long").alias("tp"))


def roc_auc(df: DataFrame, group_cols=(), label: str = "target", score: str = "score",
            n_buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Area under the ROC curve per group = P(score+ > score-) + P(tie)/2.

    0.5 when all scores are equal (the reference's guard); null when one class is
    absent (undefined). The score histogram has one row per distinct score; each row
    needs the number of negatives scored lower, an exact distributed running sum.
    """
    hist = score_histogram(df, group_cols, label, score, materialize)
    return auc_from_histogram(hist, group_cols, score, n_buckets)


def evaluate_scores(df: DataFrame, group_cols=(), label: str = "target", score: str = "score",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Metrics + AUC per group from one pass over the scored rows (via the score
    histogram)."""
    gc = list(group_cols)
    hist = score_histogram(df, gc, label, score)
    m = metrics_from_confusion(confusion_from_histogram(hist, gc, score, threshold))
    a = auc_from_histogram(hist, gc, score).select(*gc, "roc_auc")
    if gc:
        return m.join(a, gc)  # one row per group on both sides
    return m.withColumn("roc_auc", a.select("roc_auc").scalar())


def classification_report(df: DataFrame, group_cols=(), label: str = "target", pred: str = "predicted") -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro and weighted
    averages (scikit-learn's report) in long form."""
    gc = list(group_cols)
    cm = confusion(df, gc, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    per_class = F.array(
        F.struct(F.lit("0").alias("label"), F.lit(0).alias("row_ord"), _safe_div(tn, tn + fn).alias("precision"),
                 _safe_div(tn, tn + fp).alias("recall"), _safe_div(2 * tn, 2 * tn + fn + fp).alias("f1_score"),
                 (tn + fp).alias("support")),
        F.struct(F.lit("1").alias("label"), F.lit(1).alias("row_ord"), _safe_div(tp, tp + fp).alias("precision"),
                 _safe_div(tp, tp + fn).alias("recall"), _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
                 (tp + fn).alias("support")))
    rows = cm.select(*gc, F.explode(per_class).alias("r")).select(*gc, "r.*")
    acc = (cm.select(*gc, F.lit("accuracy").alias("label"), F.lit(2).alias("row_ord"),
                     F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                     _safe_div(tp + tn, tn + fp + fn + tp).alias("f1_score"), (tn + fp + fn + tp).alias("support")))
    macro = rows.groupBy(*gc).agg(
        F.lit("macro avg").alias("label"), F.lit(3).alias("row_ord"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"), F.sum("support").alias("support"))
    weighted = rows.groupBy(*gc).agg(
        F.lit("weighted avg").alias("label"), F.lit(4).alias("row_ord"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("f1_score"),
        F.sum("support").alias("support"))
    return (rows.unionByName(acc).unionByName(macro).unionByName(weighted)
            .withColumn("support", F.col("support").cast("long")))


def leaderboard(metrics: DataFrame, order_col: str = "model_ord") -> DataFrame:
    """Models by F1, best first; ties keep the benchmark order. The table has one row
    per model (bounded), so a global window is fine here."""
    w = Window.orderBy(F.desc("f1"), F.col(order_col))
    return metrics.withColumn("rank", F.row_number().over(w))


def model_selection(metrics: DataFrame, order_col: str = "model_ord") -> DataFrame:
    """Best model = highest F1 (strictly greater wins, so the earlier model keeps a tie;
    F1 = 0 never wins) and runner-ups ranked 2..4."""
    lb = leaderboard(metrics, order_col)
    best = (metrics.where(F.col("f1") > 0).withColumn("_b", F.row_number().over(Window.orderBy(F.desc("f1"), order_col)))
            .where(F.col("_b") == 1).select(F.col("model").alias("_best")))
    j = lb.join(best, F.col("model") == F.col("_best"), "left")
    role = F.when(F.col("_best").isNotNull(), "best").when(F.col("rank").between(2, 4), "runner_up")
    return j.withColumn("role", role).where(F.col("role").isNotNull()).drop("_best")


# ---- R1 / R2 / R11: risk tiers ---------------------------------------------------------------------------

# Fixed values of the scoring rules (thresholds, labels, colours, texts).
RISK_TIERS = ((0.8, "VERY HIGH", "#dc3545"), (0.6, "HIGH", "#fd7e14"), (0.4, "MEDIUM", "#ffc107"))
RISK_LOW = ("LOW", "#28a745")
ACTION_TEXT = ((0.6, "Immediate action required. Contact customer within 24 hours."),
               (0.4, "Proactive outreach recommended. Schedule call within 48 hours."))
ACTION_DEFAULT = "Monitor customer. Include in next retention campaign."
ALERT_TYPE = {"VERY HIGH": "danger", "HIGH": "warning", "MEDIUM": "info", "LOW": "success"}


def risk_columns(p: Column) -> list:
    level = F.when(p >= RISK_TIERS[0][0], RISK_TIERS[0][1])
    color = F.when(p >= RISK_TIERS[0][0], RISK_TIERS[0][2])
    for th, lab, col in RISK_TIERS[1:]:
        level = level.when(p >= th, lab)
        color = color.when(p >= th, col)
    level = level.otherwise(RISK_LOW[0])
    color = color.otherwise(RISK_LOW[1])
    action = F.when(p >= ACTION_TEXT[0][0], ACTION_TEXT[0][1]).when(p >= ACTION_TEXT[1][0], ACTION_TEXT[1][1]) \
        .otherwise(ACTION_DEFAULT)
    alert = F.create_map(*[x for k, v in ALERT_TYPE.items() for x in (F.lit(k), F.lit(v))])[level]
    return [level.alias("risk_level"), color.alias("risk_color"), action.alias("recommendation"),
            F.coalesce(alert, F.lit("secondary")).alias("alert_type")]


def risk_tiers(df: DataFrame, score: str = "score", keep=("customer_id",)) -> DataFrame:
    p = F.col(score)
    return df.select(*keep, p.alias("probability"), predict_at(p).alias("predicted_class"), *risk_columns(p))
