"""Queries of problems 3 and 6 and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .pairs import items_together
from .topn import top_n


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rates").filter((F.col("user_id") > 0) & (F.col("item_id") > 0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """For every user the five items with the highest label; of rows for the same item the latest counts."""
    rated = _known(spark, d).filter(F.col("label").isNotNull() & ~F.isnan("label"))
    last = rated.groupBy("user_id", "item_id").agg(F.max(F.struct("rated_at", "rate_id", "label")).alias("x")).select("user_id", "item_id", "x.rated_at", "x.label")
    return top_n(last, "user_id", [("label", True), ("rated_at", True), ("item_id", False)], 5, distinct=False).select("user_id", "item_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items rated by at least 8 common users, ten times as often as chance."""
    pairs = items_together(_known(spark, d), "user_id", "item_id", min_count=8, min_lift=10.0)
    return pairs.select(F.col("item_a").cast("int").alias("item_a"), F.col("item_b").cast("int").alias("item_b"))


def p6_pair_strength(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and log-likelihood ratio."""
    p = items_together(_known(spark, d), "user_id", "item_id", min_count=8, min_lift=10.0)
    return p.select("item_a", "item_b", "together", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


_PAIRS = """
WITH r AS (SELECT DISTINCT user_id AS u, item_id AS i FROM rates WHERE user_id > 0 AND item_id > 0),
n AS (SELECT count(DISTINCT u) AS n FROM r), k AS (SELECT i, count(*) AS na FROM r GROUP BY i),
c AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS c FROM r a JOIN r b ON a.u = b.u AND a.i < b.i
      WHERE a.i IN (SELECT i FROM k WHERE na >= 8) AND b.i IN (SELECT i FROM k WHERE na >= 8) GROUP BY ALL HAVING count(*) >= 8),
x AS (SELECT item_a, item_b, c, ka.na AS n_a, kb.na AS n_b, n FROM c JOIN k ka ON ka.i = item_a JOIN k kb ON kb.i = item_b, n
      WHERE c * n / (ka.na * kb.na) >= 10)
"""

QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p6_pair_strength": p6_pair_strength}
SQL = {
    "p3_found": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rated_at DESC, rate_id DESC) AS rn
           FROM rates WHERE user_id > 0 AND item_id > 0 AND label IS NOT NULL AND NOT isnan(label)),
t AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, rated_at DESC, item_id) AS k FROM r WHERE rn = 1)
SELECT user_id, item_id FROM t WHERE k <= 5""",
    "p6_found": _PAIRS + "SELECT item_a, item_b FROM x",
    "p6_pair_strength": _PAIRS + """
SELECT CAST(item_a AS BIGINT) AS item_a, CAST(item_b AS BIGINT) AS item_b, c AS together, n_a, n_b, n AS n_baskets, round(c * n / (n_a * n_b), 6) AS lift,
  round(2 * (c * ln(c / n) + CASE WHEN n_a > c THEN (n_a - c) * ln((n_a - c) / n) ELSE 0 END + CASE WHEN n_b > c THEN (n_b - c) * ln((n_b - c) / n) ELSE 0 END
    + (n - n_a - n_b + c) * ln((n - n_a - n_b + c) / n)
    - n_a * ln(n_a / n) - (n - n_a) * ln((n - n_a) / n) - n_b * ln(n_b / n) - (n - n_b) * ln((n - n_b) / n)), 4) AS llr
FROM x""",
}
