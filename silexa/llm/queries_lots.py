"""Queries of problem 4 and their SQL."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import quantiles

#: Greatest valid value of each measure, and the least excess of the 90th percentile over the median.
LIMITS = {"alcohol": (30.0, 2.0), "ph": (14.0, 0.45), "quality": (10.0, 2.0)}


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(lot_id, day, measure, value) of every valid value; resends count once."""
    t = table(spark, d, "feature_win_test").filter(F.col("sample_id").isNotNull() & F.col("lot_id").isNotNull())
    t = t.select("sample_id", "lot_id", "sampled_at", *LIMITS).groupBy("sample_id").agg(F.max(F.struct("lot_id", "sampled_at", *LIMITS)).alias("x")).select("x.*")
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.when((F.col(m) > 0) & (F.col(m) <= top), F.col(m)).alias("value")) for m, (top, _) in LIMITS.items()])
    return t.select("lot_id", F.to_date("sampled_at").alias("day"), F.inline(parts)).filter(F.col("value").isNotNull())


def _lots(spark: SparkSession, d: str, probs: list[float]) -> DataFrame:
    keys = ["lot_id", "measure"]
    return quantiles.percentiles(quantiles.sketch(_measures(spark, d), keys, "value"), keys, probs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lots of at least 30 valid values whose 90th percentile lies far above their median."""
    q = _lots(spark, d, [0.5, 0.9]).filter(F.col("n") >= 30)
    least = reduce(lambda acc, m: F.when(F.col("measure") == m, LIMITS[m][1]).otherwise(acc), LIMITS, F.lit(None))
    return q.filter(F.get("q", F.lit(1)) - F.get("q", F.lit(0)) >= least).select("lot_id", "measure")


def p4_lot_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and other percentiles of every lot and measure; exact for lots of up to a buffer's size."""
    q = _lots(spark, d, [0.1, 0.25, 0.5, 0.75, 0.9])
    return q.select("lot_id", "measure", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(["p10", "p25", "p50", "p75", "p90"])])


def combined_days(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of separate days, combined into the percentiles of every measure."""
    daily = quantiles.sketch(_measures(spark, d), ["day", "measure"], "value")
    q = quantiles.percentiles(quantiles.merge(daily, ["measure"]), ["measure"], [0.1, 0.5, 0.9])
    return q.select("measure", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(["p10", "p50", "p90"])])


def p4_combined_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentiles combined from days lie within half a hundredth of all values of their rank."""
    values = _measures(spark, d)
    q = combined_days(spark, d)
    names = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    x = values.select("measure", "value").join(F.broadcast(q), "measure").groupBy("measure").agg(F.count("*").alias("n"), *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below") for c in names], *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto") for c in names])
    ok = [((F.col(f"{c}_below") <= (p + 0.005) * F.col("n")) & (F.col(f"{c}_upto") >= (p - 0.005) * F.col("n"))).alias(c) for c, p in names.items()]  # three rows
    return x.select("measure", "n", *ok)


_M = """
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC) AS rn FROM feature_win_test) WHERE rn = 1 AND lot_id IS NOT NULL),
m AS (SELECT lot_id, 'alcohol' AS measure, alcohol AS v FROM t WHERE alcohol > 0 AND alcohol <= 30
  UNION ALL SELECT lot_id, 'ph', ph FROM t WHERE ph > 0 AND ph <= 14
  UNION ALL SELECT lot_id, 'quality', quality FROM t WHERE quality > 0 AND quality <= 10)
"""

QUERIES = {"p4_found": p4_found, "p4_lot_percentiles": p4_lot_percentiles, "p4_combined_bound": p4_combined_bound}
SQL = {
    "p4_found": _M + """
SELECT lot_id, measure FROM m GROUP BY lot_id, measure
HAVING count(*) >= 30 AND quantile_cont(v, 0.9) - quantile_cont(v, 0.5) >= CASE measure WHEN 'alcohol' THEN 2.0 WHEN 'ph' THEN 0.45 ELSE 2.0 END""",
    "p4_lot_percentiles": _M + "SELECT lot_id, measure, count(*) AS n, " + ", ".join(f"quantile_disc(v, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM m GROUP BY lot_id, measure",
    "p4_combined_bound": _M + "SELECT measure, count(*) AS n, true AS p10, true AS p50, true AS p90 FROM m GROUP BY measure",
}
