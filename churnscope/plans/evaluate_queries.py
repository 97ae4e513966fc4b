"""Evaluation queries (A26-A30, M14, T5-T7, R1/R2/R11) over ``scored`` / ``model_scores``."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.operators import evaluate as ev
from churnscope.plans.registry import register
from churnscope.plans.sqltext import tiers
from churnscope.sources.fixtures import model_scores, scored, sql_with

_CM = """CAST(SUM(CASE WHEN target = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(SUM(CASE WHEN target = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN target = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN target = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""

_METRICS = """CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp) END AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
       tn + fp + fn + tp AS n_samples"""


def _auc_sql(src: str, group: str | None) -> str:
    """Mann-Whitney with average ranks (an independent formulation of the same AUC)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    part2 = f"PARTITION BY {group}, score" if group else "PARTITION BY score"
    return f"""r AS (SELECT {g}target, score,
              RANK() OVER ({part}ORDER BY score) + (COUNT(*) OVER ({part2}) - 1) / 2.0 AS ar FROM {src}),
auc AS (SELECT {g}COUNT(DISTINCT score) AS ns, SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS np,
               SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS nn, SUM(CASE WHEN target = 1 THEN ar ELSE 0 END) AS sr
        FROM r {'GROUP BY ' + group if group else ''}),
auc2 AS (SELECT {g}CASE WHEN ns <= 1 THEN 0.5 WHEN np = 0 OR nn = 0 THEN NULL
                  ELSE CAST(sr - np * (np + 1) / 2.0 AS DOUBLE) / (CAST(np AS DOUBLE) * nn) END AS roc_auc,
                 CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg FROM auc)"""


def _pred(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("predicted", ev.predict_at(F.col("score")))


@register("confusion", sql_with(["scored"], f"""
WITH s AS (SELECT target, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM scored)
SELECT {_CM} FROM s"""), ("A26", "M14"))
def q_confusion(spark, sf_dir):
    return ev.confusion(_pred(spark, sf_dir))


@register("confusion_table", sql_with(["scored"], f"""
WITH s AS (SELECT target, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM scored),
c AS (SELECT {_CM} FROM s)
SELECT 'Actual Negative' AS actual, 0 AS row_ord, tn AS predicted_negative, fp AS predicted_positive FROM c
UNION ALL
SELECT 'Actual Positive', 1, fn, tp FROM c"""), ("A26",))
def q_confusion_table(spark, sf_dir):
    return ev.confusion_table(ev.confusion(_pred(spark, sf_dir)))


@register("classification_metrics", sql_with(["scored"], f"""
WITH s AS (SELECT target, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM scored),
c AS (SELECT {_CM} FROM s)
SELECT *, {_METRICS} FROM c"""), ("A27",))
def q_classification_metrics(spark, sf_dir):
    return ev.classification_metrics(_pred(spark, sf_dir))


@register("roc_auc", sql_with(["scored"], f"WITH {_auc_sql('scored', None)} SELECT * FROM auc2"), ("A28", "A30", "W4"))
def q_roc_auc(spark, sf_dir):
    return ev.roc_auc(scored(spark, sf_dir))


@register("classification_report", sql_with(["scored"], f"""
WITH s AS (SELECT target, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM scored),
c AS (SELECT {_CM} FROM s),
pc AS (
  SELECT '0' AS label, 0 AS row_ord, CASE WHEN tn + fn = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / (tn + fn) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS recall,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE CAST(2 * tn AS DOUBLE) / (2 * tn + fn + fp) END AS f1_score,
         tn + fp AS support FROM c
  UNION ALL
  SELECT '1', 1, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END,
         tp + fn FROM c)
SELECT label, row_ord, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', 2, NULL, NULL, CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), CAST(tn + fp + fn + tp AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', 3, AVG(precision), AVG(recall), AVG(f1_score), CAST(SUM(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', 4, SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                 SUM(f1_score * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM pc"""), ("A29",))
def q_classification_report(spark, sf_dir):
    return ev.classification_report(_pred(spark, sf_dir))


@register("risk_tiers", sql_with(["scored"], f"""
SELECT customer_id, score AS probability, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS predicted_class,
       {tiers("score", [(t[0], t[1]) for t in ev.RISK_TIERS], ev.RISK_LOW[0])} AS risk_level,
       {tiers("score", [(t[0], t[2]) for t in ev.RISK_TIERS], ev.RISK_LOW[1])} AS risk_color,
       {tiers("score", ev.ACTION_TEXT, ev.ACTION_DEFAULT)} AS recommendation,
       {tiers("score", [(t[0], ev.ALERT_TYPE[t[1]]) for t in ev.RISK_TIERS], ev.ALERT_TYPE[ev.RISK_LOW[0]])} AS alert_type
FROM scored"""), ("R1", "R2", "R11", "F11"))
def q_risk_tiers(spark, sf_dir):
    return ev.risk_tiers(scored(spark, sf_dir))


_BOARD_SQL = f"""
WITH s AS (SELECT model, model_ord, target, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM model_scores),
c AS (SELECT model, model_ord, {_CM} FROM s GROUP BY model, model_ord),
m AS (SELECT *, {_METRICS} FROM c),
{_auc_sql('model_scores', 'model')},
board AS (SELECT m.*, auc2.roc_auc, CAST(ROW_NUMBER() OVER (ORDER BY m.f1 DESC, m.model_ord) AS INTEGER) AS rank
          FROM m JOIN auc2 ON m.model = auc2.model)"""


def _board(spark, sf_dir):
    metrics = ev.evaluate_scores(model_scores(spark, sf_dir), ["model", "model_ord"])
    return metrics


@register("model_leaderboard", sql_with(["model_scores"], _BOARD_SQL + "\nSELECT * FROM board"), ("M15", "T7", "D5"))
def q_model_leaderboard(spark, sf_dir):
    return ev.leaderboard(_board(spark, sf_dir))


@register("model_selection", sql_with(["model_scores"], _BOARD_SQL + """,
best AS (SELECT model FROM board WHERE f1 > 0 ORDER BY f1 DESC, model_ord LIMIT 1)
SELECT board.*, CASE WHEN board.model IN (SELECT model FROM best) THEN 'best' ELSE 'runner_up' END AS role
FROM board WHERE board.model IN (SELECT model FROM best) OR rank BETWEEN 2 AND 4"""), ("T5", "T6"))
def q_model_selection(spark, sf_dir):
    return ev.model_selection(_board(spark, sf_dir))
