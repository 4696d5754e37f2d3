"""Evaluation of predictions: every measure comes from one aggregate or one pass over distinct scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    x = a / F.nullif(b.cast("double"), F.lit(0.0))
    return F.coalesce(x, F.lit(empty)) if empty is not None else x


def accuracy_precision_recall(df: DataFrame, label: str, prediction: str, positive: float = 1.0, tolerance: float = 1e-7) -> DataFrame:
    """(accuracy, precision, recall); equality within `tolerance`, precision and recall are 1 if nothing was (to be) found."""
    y, p = F.abs(_d(label) - positive) < tolerance, F.abs(_d(prediction) - positive) < tolerance
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(
        F.avg((F.abs(_d(label) - _d(prediction)) < tolerance).cast("double")).alias("accuracy"), _div(n(y & p), n(p), 1.0).alias("precision"), _div(n(y & p), n(y), 1.0).alias("recall")
    )


def regression_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(metric, value): rmse, mse, mae, r2"""
    e = _d(label) - _d(prediction)
    mse = F.avg(e * e)
    r2 = 1 - _div(F.sum(e * e), F.var_pop(_d(label)) * F.count(_d(label)), None)
    row = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mse", "mae", "r2")])))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, count): all that the multi-class measures need."""
    return df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("count"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, labels: list | None = None) -> DataFrame:
    """One row per true label, one column per predicted label; missing cells are 0."""
    g = confusion_counts(df, label, prediction).groupBy("label")
    return (g.pivot("prediction", labels) if labels else g.pivot("prediction")).sum("count").na.fill(0)


def per_label(df: DataFrame, label: str, prediction: str, beta: float = 1.0) -> DataFrame:
    """(label, tp, fp, fn, total, accuracy, precision, recall, f1, fpr) for every label that occurs as truth.

    A label that is never predicted has a precision of 0.
    """
    c = confusion_counts(df, label, prediction)
    n = F.sum("count").over(Window.partitionBy(F.lit(1)))  # of label pairs
    c = c.withColumn("n", n)
    t = c.groupBy("label").agg(F.sum("count").alias("total"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("tp"), F.first("n").alias("n"))
    p = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    t = t.join(p, "label", "left").withColumn("fp", F.coalesce("predicted", F.lit(0)) - F.col("tp")).withColumn("fn", F.col("total") - F.col("tp"))
    t = t.withColumn("precision", _div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _div(F.col("tp"), F.col("total")))
    b = beta * beta
    return t.select(
        "label", "tp", "fp", "fn", "total", _div(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"), "precision", "recall",
        _div((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")).alias("f1"), _div(F.col("fp"), F.col("n") - F.col("total")).alias("fpr"),
    )


def multiclass(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, weighted_precision, weighted_recall, f1): averages of the labels' measures by their frequency."""
    p = per_label(df, label, prediction)
    w = lambda c: F.sum(F.col(c) * F.col("total")) / F.sum("total")
    return p.agg((F.sum("tp") / F.sum("total")).alias("accuracy"), w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("f1"))


def threshold_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp, total_pos, total_neg, rank, n_scores) per distinct score.

    tp and fp count rows of at least that score, rank numbers the scores from the greatest down. Rows are combined to
    distinct scores first; running sums go over 64 ranges of scores in parallel, each starting from the sums of the
    ranges above it, so that no task orders all scores.
    """
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(_d(score).alias("score")).agg(F.sum(F.when(_d(label) > 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(_d(label) > 0.5, 0).otherwise(1)).alias("neg"))
    cuts = d.agg(F.percentile_approx("score", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(10_000)).alias("cuts"))  # 63 numbers
    d = d.crossJoin(F.broadcast(cuts)).withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("score")))).drop("cuts")
    sums = d.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"), F.count("*").alias("rc"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # of at most 64 rows
    whole = Window.partitionBy(F.lit(1))
    sums = sums.select("r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.sum("rp").over(whole).alias("total_pos"), F.sum("rn").over(whole).alias("total_neg"), F.coalesce(F.sum("rc").over(above), F.lit(0)).alias("bc"), F.sum("rc").over(whole).alias("n_scores"))
    w = Window.partitionBy("r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(F.broadcast(sums), "r")
    return d.select("score", "pos", "neg", (F.sum("pos").over(w) + F.col("bp")).alias("tp"), (F.sum("neg").over(w) + F.col("bn")).alias("fp"), "total_pos", "total_neg", (F.row_number().over(w) + F.col("bc")).alias("rank"), "n_scores")


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, fpr, tpr) per distinct score"""
    c = threshold_counts(df, label, score)
    return c.select("score", _div(F.col("fp"), F.col("total_neg")).alias("fpr"), _div(F.col("tp"), F.col("total_pos")).alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, recall, precision) per distinct score"""
    c = threshold_counts(df, label, score)
    return c.select("score", _div(F.col("tp"), F.col("total_pos")).alias("recall"), _div(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): exact area under the ROC curve, ties by half; null if a class is missing. An aggregate, no ordered pass."""
    c = threshold_counts(df, label, score)
    # negatives below a score win against its positives, ties count half
    return c.agg(_div(F.sum(F.col("pos") * (F.col("total_neg") - F.col("fp") + F.col("neg") / 2)), F.max("total_pos") * F.max("total_neg"), None).alias("auc"))


def auc_thresholds(df: DataFrame, label: str, score: str, steps: int = 100) -> DataFrame:
    """(auc): trapezoid area of the points at score > i / steps, i = 1..steps, closed by (1, 1); one scan for all steps."""
    s = _d(score)
    at = F.array(*[F.lit(i / steps) for i in range(1, steps + 1)])
    above = F.size(F.filter(at, lambda x: x < s))  # thresholds that the row exceeds
    h = df.filter(s.isNotNull()).groupBy(above.alias("k")).agg(F.sum(F.when(_d(label) > 0.5, 1).otherwise(0)).alias("p"), F.sum(F.when(_d(label) > 0.5, 0).otherwise(1)).alias("q"))
    ks = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    h = ks.join(h, "k", "left").na.fill(0)
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of steps + 1 rows
    whole = Window.partitionBy(F.lit(1))
    pts = h.select("k", _div(F.sum("p").over(w), F.sum("p").over(whole), None).alias("tpr"), _div(F.sum("q").over(w), F.sum("q").over(whole), None).alias("fpr"))
    # k = steps .. 1 are the thresholds from 1 down to 1 / steps; k = 0 holds all rows, the closing point (1, 1)
    prev = Window.orderBy(F.desc("k"))
    x0, y0 = F.coalesce(F.lag("fpr").over(prev), F.col("fpr")), F.coalesce(F.lag("tpr").over(prev), F.col("tpr"))
    return pts.select(((F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def area_under_pr(df: DataFrame, label: str, score: str) -> DataFrame:
    """(area): trapezoid area under the precision-recall curve, started at (0, first precision)."""
    p = threshold_counts(df, label, score).withColumn("r", F.col("tp") / F.nullif(F.col("total_pos"), F.lit(0))).withColumn("p", F.col("tp") / (F.col("tp") + F.col("fp")))
    # of a score's neighbours only the counts matter: those before it are tp - pos and fp - neg
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    p0 = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(F.col("p"))
    return p.agg(F.sum(F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * (F.col("p") + p0) / 2).alias("area"))


def binary_report(df: DataFrame, label: str, score: str) -> DataFrame:
    """(n, accuracy, max_precision, max_recall, max_f1): accuracy at score > 0.5, the rest over all thresholds."""
    c = threshold_counts(df, label, score)
    p, r = _div(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), _div(F.col("tp"), F.col("total_pos"))
    right = F.sum(F.when(F.col("score") > 0.5, F.col("pos")).otherwise(F.col("neg")))
    return c.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), (right / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"), F.max(p).alias("max_precision"), F.max(r).alias("max_recall"), F.max(_div(2 * p * r, p + r)).alias("max_f1"))


def equal_frequency(df: DataFrame, label: str, score: str, bins: int = 4) -> DataFrame:
    """(bin, score, total, pos, neg, fpr, precision, recall, f1): distinct scores in groups of n / bins + 1, descending.

    `score` is the lowest of the bin; the rates count all rows from the top to it.
    """
    c = threshold_counts(df, label, score)
    c = c.withColumn("bin", F.floor((F.col("rank") - 1) / (F.floor(F.col("n_scores") / bins) + 1)).cast("int"))
    b = c.groupBy("bin").agg(F.min("score").alias("score"), F.sum(F.col("pos") + F.col("neg")).alias("total"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("tp").alias("tp"), F.max("fp").alias("fp"), F.first("total_pos").alias("tpos"), F.first("total_neg").alias("tneg"))
    b = b.withColumn("precision", _div(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", _div(F.col("tp"), F.col("tpos")))
    return b.select("bin", "score", "total", "pos", "neg", _div(F.col("fp"), F.col("tneg")).alias("fpr"), "precision", "recall", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def equal_width(df: DataFrame, label: str, score: str, bins: int = 4) -> DataFrame:
    """(bin, total, pos, neg): scores from 0 to 1 in bins of equal width, the last one closed."""
    at = F.greatest(F.least(F.floor(_d(score) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("total"), F.sum(F.when(_d(label) > 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(_d(label) > 0.5, 0).otherwise(1)).alias("neg"))
