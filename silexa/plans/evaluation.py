"""Queries of the evaluation operators: score = l_quantity / 50, label = returned (flag A)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..session import table
from .statistics import _r


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select((F.col("l_returnflag") == "A").cast("double").alias("label"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_quantity") > 25).cast("double").alias("predicted"), "l_discount", "l_tax")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 34, "A").when(F.col("l_quantity") > 17, "N").otherwise("R").alias("prediction"))


def eval_basic(spark, d):
    return _r(ev.accuracy_precision_recall(_scored(spark, d), "label", "predicted"), 8)


def eval_regression(spark, d):
    return _r(ev.regression_errors(_scored(spark, d), "l_discount", "l_tax"), 8)


def eval_confusion(spark, d):
    return ev.confusion_matrix(_classes(spark, d), "label", "prediction", ["A", "N", "R"])


def eval_per_label(spark, d):
    return _r(ev.per_label(_classes(spark, d), "label", "prediction"), 8)


def eval_multiclass(spark, d):
    return _r(ev.multiclass(_classes(spark, d), "label", "prediction"), 8)


def eval_roc(spark, d):
    return _r(ev.roc_points(_scored(spark, d), "label", "score"), 8)


def eval_pr(spark, d):
    return _r(ev.pr_points(_scored(spark, d), "label", "score"), 8)


def eval_auc(spark, d):
    return _r(ev.auc(_scored(spark, d), "label", "score"), 8)


def eval_auc_100(spark, d):
    return _r(ev.auc_thresholds(_scored(spark, d), "label", "score"), 8)


def eval_pr_area(spark, d):
    return _r(ev.area_under_pr(_scored(spark, d), "label", "score"), 8)


def eval_binary_report(spark, d):
    return _r(ev.binary_report(_scored(spark, d), "label", "score"), 8)


def eval_equal_frequency(spark, d):
    return _r(ev.equal_frequency(_scored(spark, d), "label", "score", 4), 8)


def eval_equal_width(spark, d):
    return ev.equal_width(_scored(spark, d), "label", "score", 4)


_S = """WITH s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END AS label, l_quantity / 50 AS score, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END AS predicted, l_discount, l_tax FROM lineitem)"""
_T = _S + """, g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM s GROUP BY score),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
      row_number() OVER (ORDER BY score DESC) AS rank, count(*) OVER () AS m FROM g)"""
_C = """WITH c AS (SELECT l_returnflag AS label, CASE WHEN l_quantity > 34 THEN 'A' WHEN l_quantity > 17 THEN 'N' ELSE 'R' END AS prediction FROM lineitem),
l AS (SELECT label, count(*) AS total, count(*) FILTER (label = prediction) AS tp, (SELECT count(*) FROM c) AS n,
  (SELECT count(*) FROM c x WHERE x.prediction = c.label) AS predicted FROM c GROUP BY label),
m AS (SELECT *, predicted - tp AS fp, total - tp AS fn, coalesce(tp / nullif(predicted, 0), 0) AS precision, tp / total AS recall FROM l),
k AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""

QUERIES = {f.__name__: f for f in (eval_basic, eval_regression, eval_confusion, eval_per_label, eval_multiclass, eval_roc, eval_pr, eval_auc, eval_auc_100, eval_pr_area, eval_binary_report, eval_equal_frequency, eval_equal_width)}
SQL = {
    "eval_basic": _S + """ SELECT round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 8) AS accuracy,
      round(CAST(sum(label * predicted) / sum(predicted) AS DOUBLE), 8) AS precision, round(CAST(sum(label * predicted) / sum(label) AS DOUBLE), 8) AS recall FROM s""",
    "eval_regression": _S + """, e AS (SELECT avg(pow(l_discount - l_tax, 2)) AS mse, avg(abs(l_discount - l_tax)) AS mae, 1 - sum(pow(l_discount - l_tax, 2)) / (var_pop(l_discount) * count(*)) AS r2 FROM s)
      SELECT 'rmse' AS metric, round(sqrt(mse), 8) AS value FROM e UNION ALL SELECT 'mse', round(mse, 8) FROM e UNION ALL SELECT 'mae', round(mae, 8) FROM e UNION ALL SELECT 'r2', round(r2, 8) FROM e""",
    "eval_confusion": _C + " SELECT label, count(*) FILTER (prediction = 'A') AS A, count(*) FILTER (prediction = 'N') AS N, count(*) FILTER (prediction = 'R') AS R FROM c GROUP BY label",
    "eval_per_label": _C + " SELECT label, tp, fp, fn, total, round((n - fp - fn) / n, 8) AS accuracy, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, round(fp / (n - total), 8) AS fpr FROM k",
    "eval_multiclass": _C + " SELECT round(CAST(sum(tp) / sum(total) AS DOUBLE), 8) AS accuracy, round(CAST(sum(precision * total) / sum(total) AS DOUBLE), 8) AS weighted_precision, round(CAST(sum(recall * total) / sum(total) AS DOUBLE), 8) AS weighted_recall, round(CAST(sum(f1 * total) / sum(total) AS DOUBLE), 8) AS f1 FROM k",
    "eval_roc": _T + " SELECT round(score, 8) AS score, round(CAST(fp / n AS DOUBLE), 8) AS fpr, round(CAST(tp / p AS DOUBLE), 8) AS tpr FROM t",
    "eval_pr": _T + " SELECT round(score, 8) AS score, round(CAST(tp / p AS DOUBLE), 8) AS recall, round(CAST(tp / (tp + fp) AS DOUBLE), 8) AS precision FROM t",
    "eval_auc": _T + " SELECT round(CAST(sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS DOUBLE), 8) AS auc FROM t",
    "eval_auc_100": _S + """, k AS (SELECT range AS i FROM range(1, 101)), q AS (SELECT i, sum(CASE WHEN score > i / 100 THEN label ELSE 0 END) / sum(label) AS tpr, sum(CASE WHEN score > i / 100 THEN 1 - label ELSE 0 END) / sum(1 - label) AS fpr FROM s, k GROUP BY i
      UNION ALL SELECT 0, 1.0, 1.0), z AS (SELECT *, lag(tpr) OVER (ORDER BY i DESC) AS t0, lag(fpr) OVER (ORDER BY i DESC) AS f0 FROM q) SELECT round(CAST(sum((fpr - f0) * (tpr + t0) / 2) AS DOUBLE), 8) AS auc FROM z""",
    "eval_pr_area": _T + """, z AS (SELECT tp / p AS r, tp / (tp + fp) AS pr, lag(tp / p) OVER (ORDER BY score DESC) AS r0, lag(tp / (tp + fp)) OVER (ORDER BY score DESC) AS p0 FROM t)
      SELECT round(CAST(sum((r - coalesce(r0, 0)) * (pr + coalesce(p0, pr)) / 2) AS DOUBLE), 8) AS area FROM z""",
    "eval_binary_report": _T + """ SELECT CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(CASE WHEN score > 0.5 THEN pos ELSE neg END) / sum(pos + neg) AS DOUBLE), 8) AS accuracy, round(CAST(max(tp / (tp + fp)) AS DOUBLE), 8) AS max_precision,
      round(CAST(max(tp / p) AS DOUBLE), 8) AS max_recall, round(CAST(max(coalesce(2 * (tp / (tp + fp)) * (tp / p) / nullif(tp / (tp + fp) + tp / p, 0), 0)) AS DOUBLE), 8) AS max_f1 FROM t""",
    "eval_equal_frequency": _T + """, b AS (SELECT CAST(floor((rank - 1) / (floor(m / 4) + 1)) AS INTEGER) AS bin, min(score) AS score, CAST(sum(pos + neg) AS BIGINT) AS total, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, max(tp) AS tp, max(fp) AS fp, max(p) AS p, max(n) AS n FROM t GROUP BY 1)
      SELECT bin, round(score, 8) AS score, total, pos, neg, round(CAST(fp / n AS DOUBLE), 8) AS fpr, round(CAST(tp / (tp + fp) AS DOUBLE), 8) AS precision, round(CAST(tp / p AS DOUBLE), 8) AS recall,
      round(CAST(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) AS DOUBLE), 8) AS f1 FROM b""",
    "eval_equal_width": _S + " SELECT CAST(greatest(least(floor(score * 4), 3), 0) AS INTEGER) AS bin, count(*) AS total, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM s GROUP BY 1",
}
