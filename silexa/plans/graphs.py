"""Queries of the graph operators over whole tables: suppliers -> parts (multi-edges, parts without edges out), and suppliers with their orders."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..session import table
from .statistics import _r

ROUNDS = 5
#: Ids of the second kind of vertices start here.
APART = 1_000_000_000_000


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_edges(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") + APART).alias("part")), "l_suppkey", "part")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier linked to its orders, once."""
    return graph.load_edges(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") + APART).alias("order")).distinct(), "l_suppkey", "order")


def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


def graph_pagerank(spark, d):
    return _r(graph.pagerank(_edges(spark, d), 0.85, ROUNDS), 12)


def graph_pagerank_top(spark, d):
    names = table(spark, d, "part").select((F.col("p_partkey") + APART).alias("id"), F.col("p_name").alias("name"))
    return _r(graph.top_k(graph.pagerank(_edges(spark, d), 0.85, ROUNDS), "rank", 10, names=names), 12)


def graph_k_shell(spark, d):
    return graph.k_shell(_orders(spark, d))


def graph_influence(spark, d):
    """Cascades from two suppliers through shared orders, half of the links holding, two runs."""
    e = _orders(spark, d)
    return graph.influence(e.union(e.select("dst", "src", "weight")), [1, 2], threshold=0.9, runs=2, max_rounds=6)


def graph_neighbour_places(spark, d):
    return graph.adjacency_rank(_edges(spark, d))


_E = f"WITH RECURSIVE e AS (SELECT l_suppkey AS src, l_partkey + {APART} AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src AS id, count(*) AS o FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v)"
_PR = _E + ", r0 AS (SELECT id, 1.0::DOUBLE / n AS rank, coalesce(o, 0) AS o FROM v LEFT JOIN o USING (id), n)" + "".join(
    f""", s{k} AS (SELECT coalesce(sum(rank) FILTER (o = 0), 0) AS s FROM r{k - 1}), g{k} AS (SELECT e.dst AS id, sum(rank / o) AS g FROM e JOIN r{k - 1} r ON r.id = e.src GROUP BY 1),
r{k} AS MATERIALIZED (SELECT r.id, 0.85 * coalesce(g, 0) + 0.15 * (1 - s) / n + s / n AS rank, o FROM r{k - 1} r LEFT JOIN g{k} g ON g.id = r.id, s{k}, n)"""
    for k in range(1, ROUNDS + 1)
)
#: One cascade: a vertex is activated in the first round in which a link that holds reaches it.
_CASCADE = f"""WITH l AS (SELECT DISTINCT l_suppkey AS src, l_orderkey + {APART} AS dst FROM lineitem), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
h AS MATERIALIZED (SELECT run, src, dst FROM e, range(0, 2) r(run) WHERE CAST('0x' || substr(md5(concat_ws('/', 42, run, src, dst)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE >= 0.9),
a0 AS (SELECT run, id, 0 AS round FROM (VALUES (1), (2)) v(id), range(0, 2) r(run))""" + "".join(
    f", a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT DISTINCT h.run, h.dst, {k} FROM h JOIN a{k - 1} a ON a.run = h.run AND a.id = h.src AND a.round = {k - 1} WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} b WHERE b.run = h.run AND b.id = h.dst))" for k in range(1, 7)
)

#: Rounds of peeling that SQL unrolls; more than the test tables need, and further ones change nothing.
PEELS = 30


def _shell_sql() -> str:
    out = f"WITH e0 AS MATERIALIZED (SELECT DISTINCT l_suppkey AS src, l_orderkey + {APART} AS dst FROM lineitem), v0 AS MATERIALIZED (SELECT src AS id FROM e0 UNION SELECT dst FROM e0), k0 AS (SELECT 0 AS k)"
    for r in range(1, PEELS + 1):
        out += f""", d{r} AS MATERIALIZED (SELECT id, coalesce(d, 0) AS d FROM v{r - 1} LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e{r - 1} UNION ALL SELECT dst FROM e{r - 1}) GROUP BY id) USING (id)),
k{r} AS MATERIALIZED (SELECT greatest(any_value(k), coalesce(min(d), 0)) AS k FROM k{r - 1} LEFT JOIN d{r} ON true), v{r} AS MATERIALIZED (SELECT id FROM d{r}, k{r} WHERE d > k),
e{r} AS MATERIALIZED (SELECT src, dst FROM e{r - 1} SEMI JOIN v{r} a ON src = a.id SEMI JOIN v{r} b ON dst = b.id)"""
    return out + " " + " UNION ALL ".join(f"SELECT id, CAST(k AS INTEGER) AS shell FROM d{r}, k{r} WHERE d <= k" for r in range(1, PEELS + 1))


QUERIES = {f.__name__: f for f in (graph_degrees, graph_pagerank, graph_pagerank_top, graph_k_shell, graph_influence, graph_neighbour_places)}
SQL = {
    "graph_degrees": _E + " SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id",
    "graph_pagerank": _PR + f" SELECT id, round(rank, 12) AS rank FROM r{ROUNDS}",
    "graph_pagerank_top": _PR + f" SELECT id, round(rank, 12) AS rank, coalesce(p_name, 'null') AS name FROM (SELECT * FROM r{ROUNDS} ORDER BY rank DESC, id LIMIT 10) LEFT JOIN part ON p_partkey + {APART} = id",
    "graph_k_shell": _shell_sql(),
    "graph_influence": _CASCADE + " SELECT round, count(*) / 2.0::DOUBLE AS activated FROM a6 WHERE round > 0 GROUP BY round",
    "graph_neighbour_places": _E + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS id, count(*) AS neighbours FROM u GROUP BY src) SELECT id, neighbours, rank() OVER (ORDER BY neighbours DESC) AS place FROM c",
}
