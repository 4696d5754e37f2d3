"""Queries of the scalar, map, vector and matrix functions, and of the streaming operators."""
from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import vectors as vec
from ..session import stage_path, table
from ..streaming import aggregates
from .statistics import _r


def scalar_parse(spark, d):
    """Numbers, `k:v` pairs and escapes from text."""
    e = table(spark, d, "events").select(
        "event_id", F.concat(F.lit("a:"), F.col("event_id") % 7, F.lit(",x:y:"), F.col("event_type"), F.lit(",a:9,bad")).alias("pairs"), F.concat(F.lit("l\\t"), F.col("event_type"), F.lit("\\\\n\\u00e9")).alias("escaped"), "event_type",
        F.get_json_object("props", "$.k").alias("k"),
    )
    p = e.withColumn("m", scalars.parse_pairs("pairs"))
    return p.select("event_id", F.element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("x:y")).alias("xy"), F.size("m").alias("n"), scalars.unescape("escaped").alias("text"), scalars.parse_int("k").alias("k"), scalars.parse_double("event_type").alias("none"))


def scalar_draws(spark, d):
    """Repeatable draws per key."""
    e = table(spark, d, "events").select("event_id")
    return e.select("event_id", scalars.bernoulli(0.3, "event_id").alias("bernoulli"), scalars.multinomial([1, 2, 5], "event_id", 7).alias("multinomial"), scalars.poisson(1.5, "event_id", 9).alias("poisson"))


def scalar_kernels(spark, d):
    x = F.col("value") / 50 - 1
    return _r(table(spark, d, "events").select("event_id", *[scalars.kernel(x, k).alias(k.lower()) for k in ("None", "Sigmoid", "Polynomial")]), 8)


def scalar_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalars.as_json("event_id", "event_type").alias("json"))


def vector_maps(spark, d):
    """Sparse vectors as maps."""
    e = table(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.col("event_id") % 5).cast("double").alias("w"))
    m = e.select("event_id", F.create_map(F.lit(1), "v", F.lit(4), "w").alias("a"), F.create_map(F.lit(1), "w", F.lit(2), F.lit(2.0)).alias("b"))
    total = lambda x: vec.total(F.map_values(x))
    return _r(m.select(
        "event_id", vec.sparse_dot("a", "b").alias("dot"), vec.sparse_norm("a").alias("norm"), total(vec.sparse_add("a", "b")).alias("sum"), F.size(vec.sparse_compact("a")).alias("kept"), total(vec.sparse_scale("b", 3.0)).alias("scaled"),
        vec.sparse_get("a", F.lit(9)).alias("absent"), F.get(vec.sparse_to_dense("b", 4), F.lit(2)).alias("dense"), F.size(vec.swap("b")).alias("swapped"), vec.sparse_to_text(F.transform_values("b", lambda k, x: x.cast("int"))).alias("text"),
    ), 6)


def vector_arithmetic(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).withColumn("y", F.reverse("x"))
    return _r(v.select(
        "vec_id", vec.total(vec.add("x", "y")).alias("sum"), vec.norm(vec.subtract("x", "y")).alias("gap"), vec.total(vec.multiply("x", "y")).alias("product"), vec.total(vec.divide("x", vec.constant(64, 2.0))).alias("half"), vec.total(vec.scale("x", 3.0)).alias("three"),
        vec.argmin("x").alias("argmin"), F.get(vec.top("x", 2), F.lit(1))["v"].alias("second"), vec.norm(vec.normalize("x")).alias("unit"), vec.equal("x", F.reverse("y")).alias("same"), F.get(F.get(vec.outer("x", "y"), F.lit(0)), F.lit(0)).alias("corner"),
    ), 6)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 5).cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))


def matrix_sums(spark, d):
    """Row and column sums, a product with a vector, and shares of all cells."""
    c = _cells(spark, d)
    x = vec.column_sums(c).select(F.col("j").alias("i"), "v")
    parts = [vec.row_sums(c).select(F.lit("row").alias("kind"), F.col("i").cast("bigint").alias("at"), "v"), vec.column_sums(c).select(F.lit("column"), F.col("j").cast("bigint"), "v"), vec.matrix_vector(c, x).select(F.lit("product"), F.col("i").cast("bigint"), "v")]
    share = vec.normalize_all(c).groupBy(F.col("i").cast("bigint")).agg(F.sum("v").alias("v"))
    return _r(parts[0].union(parts[1]).union(parts[2]).union(share.select(F.lit("share"), "i", "v")), 8)


def stream_windowed_counts(spark, d):
    """Events counted by hour as a stream: windows that the watermark has passed."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stage_path(spark, "stream")
    counts = aggregates.windowed_counts(stream, "ts", "event_type", "1 hour", late="10 minutes")
    counts.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "item", "count")


_U = lambda key, seed: f"CAST('0x' || substr(md5({key} || '/{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_PO = "CASE " + " ".join(f"WHEN u3 < {c} THEN {k}" for k, c in enumerate(accumulate(exp(-1.5) * 1.5**i / factorial(i) for i in range(12)))) + " ELSE 12 END"
_CELLS = "WITH c AS (SELECT c_nationkey AS i, CAST(c_custkey % 5 AS INTEGER) AS j, count(*)::DOUBLE AS v FROM customer GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (scalar_parse, scalar_draws, scalar_kernels, scalar_json, vector_maps, vector_arithmetic, matrix_sums, stream_windowed_counts)}
SQL = {
    "scalar_parse": "SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS a, event_type AS xy, 2 AS n, 'l' || chr(9) || event_type || chr(92) || 'n' || chr(233) AS text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS DOUBLE) AS none FROM events",
    "scalar_draws": f"SELECT event_id, u1 < 0.3 AS bernoulli, CASE WHEN u2 * 8 < 1 THEN 0 WHEN u2 * 8 < 3 THEN 1 ELSE 2 END AS multinomial, {_PO} AS poisson FROM (SELECT event_id, {_U('event_id', 42)} AS u1, {_U('event_id', 7)} AS u2, {_U('event_id', 9)} AS u3 FROM events)",
    "scalar_kernels": "SELECT event_id, round(x, 8) AS none, round(1 / (1 + exp(-x)), 8) AS sigmoid, round(x * x, 8) AS polynomial FROM (SELECT event_id, value / 50 - 1 AS x FROM events)",
    "scalar_json": """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""",
    "vector_maps": """WITH e AS (SELECT event_id, value AS v, (event_id % 5)::DOUBLE AS w FROM events) SELECT event_id, round(v * w, 6) AS dot, round(sqrt(v * v + w * w), 6) AS norm, round(v + w + w + 2, 6) AS sum, CAST((v <> 0)::INTEGER + (w <> 0)::INTEGER AS INTEGER) AS kept,
      round(3 * (w + 2), 6) AS scaled, 0.0::DOUBLE AS absent, 2.0::DOUBLE AS dense, CASE WHEN w = 2 THEN 1 ELSE 2 END AS swapped, '1:' || CAST(w AS INTEGER) || ',2:2' AS text FROM e""",
    "vector_arithmetic": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), w AS (SELECT *, list_reverse(x) AS y FROM v)
      SELECT vec_id, round(2 * list_sum(x), 6) AS sum, round(list_distance(x, y), 6) AS gap, round(list_dot_product(x, y), 6) AS product, round(list_sum(x) / 2, 6) AS half, round(3 * list_sum(x), 6) AS three, CAST(list_position(x, list_min(x)) - 1 AS INTEGER) AS argmin,
      round(list_reverse_sort(x)[2], 6) AS second, 1.0::DOUBLE AS unit, true AS same, round(x[1] * x[64], 6) AS corner FROM w""",
    "matrix_sums": _CELLS + """, s AS (SELECT j, sum(v) AS s FROM c GROUP BY j), t AS (SELECT sum(v) AS t FROM c)
      SELECT 'row' AS kind, CAST(i AS BIGINT) AS at, round(sum(v), 8) AS v FROM c GROUP BY i UNION ALL SELECT 'column', j, round(sum(v), 8) FROM c GROUP BY j
      UNION ALL SELECT 'product', i, round(sum(v * s), 8) FROM c JOIN s USING (j) GROUP BY i UNION ALL SELECT 'share', i, round(sum(v) / any_value(t), 8) FROM c, t GROUP BY i""",
    "stream_windowed_counts": "SELECT start, item, count(*) AS count FROM (SELECT date_trunc('hour', ts) AS start, event_type AS item FROM events), (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events) WHERE start + INTERVAL 1 HOUR <= w GROUP BY start, item",
}
