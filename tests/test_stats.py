import math

import pytest
from pyspark.sql import functions as F

from silexa.operators import evaluate as ev
from silexa.operators import stats


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1.0, 2, "a", 1.0), (3.0, None, "b", 2.0), (0.0, 4, "a", 1.0), (None, 4, None, 4.0)], "x double, y int, s string, w double")


def test_summary_skips_nulls_and_counts_zeros(df):
    r = {x["column"]: x for x in stats.summary(df, ["x", "y"]).collect()}
    assert (r["x"]["count"], r["x"]["sum"], r["x"]["num_non_zeros"], r["x"]["min"], r["x"]["max"]) == (3, 4.0, 2, 0.0, 3.0)
    assert r["x"]["range"] == 3.0 and r["x"]["group_interval"] == pytest.approx(0.3) and r["x"]["norm_l2"] == pytest.approx(math.sqrt(10))
    assert r["y"]["variation_coefficient"] == pytest.approx(r["y"]["std"] / r["y"]["mean"])


def test_summary_of_nothing_and_unknown_metric(df):
    r = stats.summary(df.limit(0), ["x"]).first()
    assert r["count"] == 0 and r["mean"] is None
    with pytest.raises(ValueError):
        stats.summary(df, ["x"], ["median"])


def test_weighted_variance(df):
    r = stats.weighted_summary(df, ["x"], "w").first()
    w, x = [1, 2, 1], [1, 3, 0]
    mean = sum(a * b for a, b in zip(w, x)) / 4
    assert r["mean"] == mean and r["variance"] == pytest.approx(sum(a * (b - mean) ** 2 for a, b in zip(w, x)) / (4 - 6 / 4))


def test_histogram_sums_to_the_rows(df, spark):
    h = stats.histogram(df, ["x", "y"]).collect()
    assert len(h) == 20 and sum(r["count"] for r in h if r["column"] == "x") == 3
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"]) if r["column"] == "x"][9] == 1  # the last bin is closed
    c = stats.histogram(spark.createDataFrame([(5.0,)] * 4, "x double"), ["x"]).filter("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in c] == [(0, 4)]


def test_mode_breaks_ties_by_value(spark):
    d = spark.createDataFrame([(2.0,), (1.0,), (None,)], "x double")
    r = {x["metric"]: x["x"] for x in stats.central_position(d, ["x"], ["mode", "median"], [0.5]).collect()}
    assert r == {"mode": 1.0, "median": 1.5, "quantile-0.5": 1.0}


def test_z_score_of_a_constant_is_null(spark):
    assert [r["x_zscore"] for r in stats.z_score(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"]).collect()] == [None, None]


def test_covariance_is_symmetric(df):
    m = {r["dim"]: r for r in stats.covariance_matrix(df, ["x", "y", "w"]).collect()}
    assert m["x"]["w"] == m["w"]["x"] and m["x"]["x"] == pytest.approx(stats.summary(df, ["x"], ["variance"]).first()["variance"])


def test_ratio_counts_nulls_as_unequal(df):
    assert stats.ratio(df, "s", "a").first()["ratio"] == 0.5
    assert stats.ratio_difference(df, df.filter("s = 'a'"), "s", "a").first()["ratio_difference"] == -0.5


def test_pivot_fills_zero(df):
    rows = {r["s"]: r for r in stats.pivot(df, "s", "y", "w", [2, 4]).collect()}
    assert rows["b"]["2"] == 0.0 and rows["a"]["4"] == 1.0


def test_binary_measures(spark):
    d = spark.createDataFrame([(1.0, 0.9), (1.0, 0.8), (0.0, 0.8), (0.0, 0.1), (1.0, 0.3), (0.0, 0.2)], "label double, score double")
    pos, neg = [0.9, 0.8, 0.3], [0.8, 0.1, 0.2]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / 9
    assert ev.auc(d, "label", "score").first()["auc"] == pytest.approx(want)
    roc = ev.roc_points(d, "label", "score").orderBy(F.desc("score")).collect()
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0) and len(roc) == 5
    assert ev.binary_report(d, "label", "score").first()["max_recall"] == 1.0
    assert [r["rank"] for r in ev.threshold_counts(d, "label", "score").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert sum(r["total"] for r in ev.equal_frequency(d, "label", "score", 2).collect()) == 6
    assert ev.auc(d.filter("label = 1"), "label", "score").first()["auc"] is None
    assert ev.auc(d.limit(0), "label", "score").first()["auc"] is None


def test_per_label_of_a_label_never_predicted(spark):
    d = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c")], "y string, p string")
    r = {x["label"]: x for x in ev.per_label(d, "y", "p").collect()}
    assert set(r) == {"a", "b"} and r["b"]["precision"] == 0.0 and r["a"]["precision"] == 0.5 and r["a"]["recall"] == 0.5
    assert ev.accuracy_precision_recall(spark.createDataFrame([(0.0, 0.0)], "y double, p double"), "y", "p").first()["precision"] == 1.0


def test_streaming_counts(spark, tmp_path):
    import datetime as dt

    from silexa.streaming.aggregates import windowed_counts, windowed_summary

    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t + dt.timedelta(minutes=20 * i), "ab"[i % 2], float(i)) for i in range(9)], "t timestamp, s string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, s string, v double").parquet(str(tmp_path / "in"))
    for name, out in (("counted", windowed_counts(stream, "t", "s")), ("summed", windowed_summary(stream, "t", "v"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sum(r["count"] for r in spark.table("counted").collect()) == 9 and spark.table("summed").agg(F.sum("count")).first()[0] == 9
