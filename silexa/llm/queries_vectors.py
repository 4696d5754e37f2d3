"""Queries of problems 1 and 7."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .clusters import Measure, isolated, similarity_clusters
from .neighbours import most_similar
from .vectors import canonical

SIDES = {"fs": ("labeled_points", "point_id", "fs_idx", "fs_val"), "u_fs": ("svd_feature_points", "user_key", "u_fs_idx", "u_fs_val"), "i_fs": ("svd_feature_points", "item_key", "i_fs_idx", "i_fs_val")}


def _neighbours(spark: SparkSession, d: str, complete: bool) -> DataFrame:
    each = [table(spark, d, name).select(F.lit(side).alias("side"), F.col(key).alias("key"), F.col(idx).alias("idx"), F.col(val).alias("val")) for side, (name, key, idx, val) in SIDES.items()]
    return most_similar(reduce(DataFrame.unionByName, each), "key", "idx", "val", k=10, min_cosine=0.94, complete=complete, space="side")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the ten most similar vectors of every vector of the three collections, however similar they are."""
    return _neighbours(spark, d, complete=True).withColumn("cosine", F.round("cosine", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of cosine >= 0.94 where one is among the ten most similar of the other."""
    near = _neighbours(spark, d, complete=False).filter(F.col("cosine") >= 0.94)
    return near.select("side", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


#: Any two flowers of a group lie at most 1.0 apart, all others more than 1.1; points by cosine. Flowers within 1.1 share more than 0.37 of
#: the squares of 8 x 8 cells around them.
FLOWERS = Measure("euclid", strict=1.0, loose=1.1, jaccard=0.35, cell=0.5, reach=4)
POINTS = Measure("cosine", strict=0.6, loose=0.5, jaccard=0.3)


def _flowers(spark: SparkSession, d: str) -> DataFrame:
    """(key, bed, x, y) of flowers with both lengths; resends count once."""
    t = table(spark, d, "iris_wheader").filter(F.col("flower_id").isNotNull() & F.col("bed_id").isNotNull())
    t = t.groupBy("flower_id").agg(F.max_by(F.struct("bed_id", "sepal_len", "petal_len"), F.struct("loaded_at", F.xxhash64("sepal_len", "petal_len"))).alias("r"))
    t = t.select(F.col("flower_id").alias("key"), F.col("r.bed_id").alias("bed"), F.col("r.sepal_len").alias("x"), F.col("r.petal_len").alias("y"))
    return t.filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))


def _flower_records(flowers: DataFrame) -> DataFrame:
    place = F.array(F.lit(0), F.lit(1)).cast("array<bigint>")
    return flowers.select("key", F.xxhash64("bed").alias("space"), F.xxhash64(F.lit("iris"), "bed", "x", "y").alias("cls"), place.alias("idx"), F.array("x", "y").alias("val"))


def _point_records(spark: SparkSession, d: str) -> DataFrame:
    v = canonical(table(spark, d, "labeled_points"), "point_id", "fs_idx", "fs_val")
    return v.select("key", F.lit(0).cast("bigint").alias("space"), "cls", "idx", "val")


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members and groups of flowers (m = 0) and points (m = 1)."""
    records = _flower_records(_flowers(spark, d)).withColumn("m", F.lit(0)).unionByName(_point_records(spark, d).withColumn("m", F.lit(1)))
    return similarity_clusters(records, (FLOWERS, POINTS))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of isolated groups of at least five mutually similar records."""
    members, groups = _clusters(spark, d)
    groups = groups.filter(F.col("whole") & (F.col("size") >= 5)).select("m", "cluster")
    placed = _flowers(spark, d).join(members.filter("m = 0"), "key").select("key", "cluster", F.col("bed").alias("space"), "x", "y")
    iris = isolated(placed.join(groups.filter("m = 0").select("cluster"), "cluster"), placed, FLOWERS.loose).select(F.lit("iris").alias("src"), "key", "cluster")
    points = members.filter("m = 1").join(groups.filter("m = 1").select("cluster"), "cluster").select(F.lit("points").alias("src"), "key", "cluster")
    return iris.union(points).select("src", F.col("key").alias("member_id"), F.col("cluster").alias("cluster_id"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every group's size and most typical members."""
    return _clusters(spark, d)[1].select(F.when(F.col("m") == 0, "iris").otherwise("points").alias("src"), F.col("cluster").alias("cluster_id"), "size", "whole", "typical")


def p7_tight_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of every group whose records are all similar to each other."""
    return p7_groups(spark, d).filter("whole").select("src", "cluster_id", "size", F.array_join("typical", " ").alias("typical"))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p7_found": p7_found, "p7_groups": p7_groups, "p7_tight_groups": p7_tight_groups}
#: Unit entries (side, key, i, v) of the canonical vectors, and cosines of all pairs that share an index.
_VECTORS = """
WITH raw AS (SELECT 'fs' AS side, point_id AS key, fs_idx AS i, fs_val AS v FROM labeled_points
  UNION ALL SELECT 'u_fs', user_key, u_fs_idx, u_fs_val FROM svd_feature_points UNION ALL SELECT 'i_fs', item_key, i_fs_idx, i_fs_val FROM svd_feature_points),
one AS (SELECT side, key, i, v FROM (SELECT *, row_number() OVER (PARTITION BY side, key ORDER BY len(i) DESC) AS rn FROM raw WHERE key IS NOT NULL AND len(i) > 0) WHERE rn = 1),
e AS (SELECT side, key, unnest(i) AS i, unnest(v) AS v FROM one), n AS (SELECT side, key, sqrt(sum(v * v)) AS n FROM e WHERE v <> 0 GROUP BY ALL),
u AS (SELECT e.side, e.key, i, v / n AS v FROM e JOIN n ON e.side = n.side AND e.key = n.key WHERE v <> 0),
c AS MATERIALIZED (SELECT a.side AS side, a.key AS a, b.key AS b, round(sum(a.v * b.v), 9) AS c FROM u a JOIN u b ON a.side = b.side AND a.i = b.i AND a.key <> b.key GROUP BY ALL)
"""
#: A group is a record's neighbourhood in the loose sense, if all its members have the same one and are close in the strict sense.
_GROUPS = """
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flower_id ORDER BY loaded_at DESC) AS rn FROM iris_wheader)
  WHERE rn = 1 AND flower_id IS NOT NULL AND bed_id IS NOT NULL AND NOT isnan(coalesce(sepal_len, 'nan')) AND NOT isnan(coalesce(petal_len, 'nan'))),
d AS (SELECT 'iris' AS src, a.flower_id AS a, b.flower_id AS b, sqrt(pow(a.sepal_len - b.sepal_len, 2) + pow(a.petal_len - b.petal_len, 2)) AS d FROM t a JOIN t b ON a.bed_id = b.bed_id),
near AS (SELECT src, a, b, d <= 1.0 + 1e-9 AS strict, -d AS close FROM d WHERE d <= 1.1 + 1e-9 UNION ALL SELECT 'points', a, b, c >= 0.6, c FROM c WHERE side = 'fs' AND c >= 0.5
  UNION ALL SELECT DISTINCT 'points', key, key, true, 1.0 FROM u WHERE side = 'fs'),
g AS (SELECT src, a, list(b ORDER BY b) AS members, bool_and(strict) AS strict FROM near GROUP BY src, a),
w AS (SELECT src, members FROM g GROUP BY src, members HAVING count(*) = len(members) AND bool_and(strict))
"""
SQL = {
    "p1_found": _VECTORS + """, r AS (SELECT side, a, b, row_number() OVER (PARTITION BY side, a ORDER BY c DESC, b) AS k FROM c WHERE c >= 0.94)
SELECT DISTINCT side, least(a, b) AS key_a, greatest(a, b) AS key_b FROM r WHERE k <= 10""",
    "p7_found": _VECTORS + _GROUPS.replace("WITH t AS", ", t AS", 1) + "SELECT src, unnest(members) AS member_id, list_min(members) AS cluster_id FROM w WHERE len(members) >= 5",
    "p7_tight_groups": _VECTORS + _GROUPS.replace("WITH t AS", ", t AS", 1) + """, r AS (SELECT 'iris' AS src, min(flower_id) AS a FROM t GROUP BY bed_id, sepal_len, petal_len
  UNION ALL SELECT 'points', min(key) FROM (SELECT key, list((i, round(v, 6)) ORDER BY i) AS x FROM u WHERE side = 'fs' GROUP BY key) GROUP BY x),
m AS (SELECT src, list_min(members) AS cluster_id, len(members) AS size, unnest(members) AS a FROM w),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.src, cluster_id ORDER BY total DESC, m.a) AS k FROM m JOIN (SELECT src, a, round(sum(close), 9) AS total FROM near GROUP BY ALL) USING (src, a) JOIN r USING (src, a))
SELECT src, cluster_id, any_value(size) AS size, string_agg(a, ' ' ORDER BY k) AS typical FROM k WHERE k <= 3 GROUP BY src, cluster_id""",
    # every pair of a side, also those without a common index
    "p1_neighbours": _VECTORS + """, k AS (SELECT DISTINCT side, key FROM u),
r AS (SELECT x.side, x.key, y.key AS other, coalesce(c.c, 0) AS c, row_number() OVER (PARTITION BY x.side, x.key ORDER BY coalesce(c.c, 0) DESC, y.key) AS rank
  FROM k x JOIN k y ON x.side = y.side AND x.key <> y.key LEFT JOIN c ON c.side = x.side AND c.a = x.key AND c.b = y.key)
SELECT side, key, other, round(c, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
}
