"""Queries of the statistics operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..session import table

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df: DataFrame, digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded: engines add in different orders."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _li(spark, d)
    return t.filter("l_returnflag = 'A'"), t.filter("l_returnflag = 'R'")


def stats_summary(spark, d):
    return _r(stats.summary(_li(spark, d), COLS))


def stats_weighted(spark, d):
    return _r(stats.weighted_summary(_li(spark, d), ["l_extendedprice", "l_discount"], "l_quantity"))


def stats_transposed(spark, d):
    metrics = ["mean", "max", "min", "count"]
    return _r(stats.transpose_metrics(stats.summary(_li(spark, d), COLS, metrics), COLS, metrics))


def stats_histogram(spark, d):
    return stats.histogram(_li(spark, d), COLS).select("column", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


def stats_report(spark, d):
    r = stats.statistics_report(_li(spark, d), COLS, ["mean", "max", "min", "group_interval"])
    return r.select("column", F.round("mean", 4).alias("mean"), F.size("density").alias("bins"), F.aggregate(F.map_values("density"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("counted"))


def stats_central(spark, d):
    return _r(stats.central_position(_li(spark, d), COLS, ["mode", "median", "mean", "max"], accuracy=None), 6)


def stats_central_approximate(spark, d):
    """Modes are exact; whether median and quantiles by the default accuracy lie within a thousandth of their rank."""
    li = _li(spark, d)
    q = stats.central_position(li, COLS, ["mode", "median"]).filter("metric <> 'mode'")
    long = q.select("metric", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in COLS])))
    v = stats.value_counts(li, COLS).join(F.broadcast(long), "column").groupBy("column", "metric").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("x") < F.col("q"), F.col("count")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("q"), F.col("count")).otherwise(0)).alias("upto"))  # a row per column and metric
    p = F.coalesce(F.try_to_number(F.replace("metric", F.lit("quantile-"), F.lit("")), F.lit("9.99")).cast("double"), F.lit(0.5))
    return v.select("column", "metric", "n", ((F.col("below") <= (p + 0.001) * F.col("n")) & (F.col("upto") >= (p - 0.001) * F.col("n"))).alias("within"))


def stats_lower_median(spark, d):
    return stats.lower_median(_li(spark, d), COLS)


def stats_deviation(spark, d):
    return _r(stats.deviation(_li(spark, d), COLS), 6)


def stats_z_score(spark, d):
    return _r(stats.z_score(_li(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]), 6)


def stats_covariance(spark, d):
    return _r(stats.covariance_matrix(_li(spark, d), COLS))


def stats_mean_estimation(spark, d):
    return _r(stats.mean_estimation(table(spark, d, "orders"), ["o_totalprice"]))


def stats_variance_estimation(spark, d):
    return _r(stats.variance_estimation(table(spark, d, "orders"), ["o_totalprice"]), 1)


def stats_mean_difference(spark, d):
    return _r(stats.mean_difference(*_sides(spark, d), COLS), 6)


def stats_variance_ratio(spark, d):
    return _r(stats.variance_ratio(*_sides(spark, d), COLS), 6)


def stats_ratio(spark, d):
    return _r(stats.ratio(_li(spark, d), "l_returnflag", "A"), 8)


def stats_ratio_difference(spark, d):
    return _r(stats.ratio_difference(*_sides(spark, d), "l_linestatus", "O"), 8)


def stats_pivot(spark, d):
    return _r(stats.pivot(_li(spark, d), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]), 2)


def stats_counter(spark, d):
    return stats.counter(table(spark, d, "events"), "event_type")


def stats_top_items(spark, d):
    return stats.top_items(_li(spark, d), "l_partkey", 20)


def stats_group_by_cube(spark, d):
    """Grouping sets, which SQL scripts reach."""
    t = _li(spark, d).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))
    return t.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "suppliers")


def _each(sql: str, cols: list[str] = COLS, table_: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT {sql.format(c=c)} FROM {table_}" for c in cols)


_M13 = (
    "'{c}' AS \"column\", round(avg({c}), 4) AS mean, round(sum({c}), 4) AS sum, round(var_samp({c}), 4) AS variance, round(stddev_samp({c}), 4) AS std, CAST(count({c}) AS DOUBLE) AS count, "
    "CAST(sum(CASE WHEN {c} <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS num_non_zeros, round(max({c}), 4) AS max, round(min({c}), 4) AS min, round(sqrt(sum({c} * {c})), 4) AS norm_l2, "
    "round(sum(abs({c})), 4) AS norm_l1, round(max({c}) - min({c}), 4) AS range, round((max({c}) - min({c})) / 10, 4) AS group_interval, round(stddev_samp({c}) / avg({c}), 4) AS variation_coefficient"
)


def _rows(metrics: dict[str, str], digits: int = 6) -> str:
    """A `metric` row per expression, a column per input."""
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"CAST(round({e.format(c=c)}, {digits}) AS DOUBLE) + 0.0::DOUBLE AS {c}" for c in COLS) + " FROM lineitem" for m, e in metrics.items())


_MODE = "max((SELECT {c} FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY {c}) ORDER BY n DESC, {c} LIMIT 1))"
_SKEW = "(avg({c}*{c}*{c}) - 3*avg({c})*avg({c}*{c}) + 2*avg({c})*avg({c})*avg({c})) / pow(var_pop({c}), 1.5)"
_TWO = "WITH a AS (SELECT * FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT * FROM lineitem WHERE l_returnflag = 'R') "

QUERIES = {
    f.__name__: f
    for f in (
        stats_summary, stats_weighted, stats_transposed, stats_histogram, stats_report, stats_central, stats_central_approximate, stats_lower_median, stats_deviation, stats_z_score, stats_covariance, stats_mean_estimation,
        stats_variance_estimation, stats_mean_difference, stats_variance_ratio, stats_ratio, stats_ratio_difference, stats_pivot, stats_counter, stats_top_items, stats_group_by_cube,
    )
}
SQL = {
    "stats_summary": _each(_M13),
    "stats_weighted": _each(
        "'{c}' AS \"column\", sum(l_quantity) AS weight_sum, round(sum(l_quantity * {c}) / sum(l_quantity), 4) AS mean, "
        "round((sum(l_quantity * {c} * {c}) - pow(sum(l_quantity * {c}), 2) / sum(l_quantity)) / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity)), 4) AS variance",
        ["l_extendedprice", "l_discount"],
    ),
    "stats_transposed": _rows({"mean": "avg({c})", "max": "max({c})", "min": "min({c})", "count": "count({c})"}, 4),
    "stats_histogram": "WITH x AS ("
    + _each("'{c}' AS \"column\", CAST({c} AS DOUBLE) AS x")
    + """), b AS (SELECT "column", min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM x GROUP BY "column"),
g AS (SELECT "column", lo, w, bin FROM b, (SELECT CAST(range AS INTEGER) AS bin FROM range(10))),
h AS (SELECT x."column", CAST(least(floor((x - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM x JOIN b USING ("column") GROUP BY ALL)
SELECT g."column", g.bin, round(lo + g.bin * w, 6) AS lo, round(lo + g.bin * w + w, 6) AS hi, coalesce(n, 0) AS count FROM g LEFT JOIN h ON g."column" = h."column" AND g.bin = h.bin""",
    "stats_report": _each("'{c}' AS \"column\", round(avg({c}), 4) AS mean, 10 AS bins, count({c}) AS counted"),
    "stats_central": _rows({"mode": _MODE, "median": "median({c})", "mean": "avg({c})", "max": "max({c})", **{f"quantile-{p}": f"quantile_disc({{c}}, {p})" for p in (0.25, 0.5, 0.75, 1.0)}}),
    "stats_central_approximate": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", unnest(['median', 'quantile-0.25', 'quantile-0.5', 'quantile-0.75', 'quantile-1.0']) AS metric, count({c}) AS n, true AS within FROM lineitem" for c in COLS),
    "stats_lower_median": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median FROM lineitem" for c in COLS),
    "stats_deviation": _rows({"skewness": _SKEW, "kurtosis": "kurtosis_pop({c})", "mean": "avg({c})", "stddev": "stddev_samp({c})"}),
    "stats_z_score": "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity_zscore FROM lineitem",
    "stats_covariance": " UNION ALL ".join(f"SELECT '{a}' AS dim, " + ", ".join(f"round(covar_samp({a}, {b}), 4) + 0.0::DOUBLE AS {b}" for b in COLS) + " FROM lineitem" for a in COLS),
    "stats_mean_estimation": "SELECT 'o_totalprice' AS \"column\", round(avg(o_totalprice), 4) AS mean FROM orders",
    "stats_variance_estimation": "SELECT 'o_totalprice' AS \"column\", round(var_samp(o_totalprice), 1) AS variance FROM orders",
    "stats_mean_difference": _TWO + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((SELECT avg({c}) FROM a) - (SELECT avg({c}) FROM r), 6) AS mean_difference" for c in COLS),
    "stats_variance_ratio": _TWO + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((SELECT var_samp({c}) FROM a) / (SELECT var_samp({c}) FROM r), 6) AS variance_ratio" for c in COLS),
    "stats_ratio": "SELECT round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END), 8) AS ratio FROM lineitem",
    "stats_ratio_difference": _TWO + "SELECT round((SELECT avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) FROM a) - (SELECT avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) FROM r), 8) AS ratio_difference",
    "stats_pivot": "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS F, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS O FROM lineitem GROUP BY 1",
    "stats_counter": "SELECT event_type AS item, count(*) AS count FROM events GROUP BY 1",
    "stats_top_items": "SELECT l_partkey AS item, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, item LIMIT 20",
    "stats_group_by_cube": "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
