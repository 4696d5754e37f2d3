"""Graph analytics on edge tables (src, dst): joins and aggregates per superstep, reliable lineage cuts between them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..session import cut, staged


def load_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, reverse: bool = False) -> DataFrame:
    """(src, dst, weight): edges with a weight of 1.0 unless given; `reverse` swaps their direction. Null ends are dropped."""
    a, b = (dst, src) if reverse else (src, dst)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("weight")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); multi-edges count."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 15, every: int = 3) -> DataFrame:
    """(id, rank): start 1/N; r'(v) = d * (sum of r(u) / outdeg(u)) + (1 - d)(1 - S) / N + S / N with S the dangling ranks.

    The ranks always sum to 1. Multi-edges are summed into one weight beforehand, each superstep is one join and one
    partial aggregation, and lineage is cut every `every` rounds.
    """
    d = degrees(edges)
    vertices = staged(d.select("id", "out_degree"), "vertices")
    links = staged(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(vertices.select(F.col("id").alias("src"), "out_degree"), "src").select("src", "dst", (F.col("m") / F.col("out_degree")).alias("share")), "links")
    n = vertices.count()
    ranks = vertices.select("id", "out_degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit(damping) * F.coalesce("got", F.lit(0.0)) + (1 - damping) * (1 - F.col("lost")) / n + F.col("lost") / n
        ranks = vertices.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", "out_degree", new.alias("rank"))
        if (k + 1) % every == 0:
            ranks = cut(ranks)
    return ranks.select("id", "rank")


def top_k(df: DataFrame, value: str, k: int = 20, key: str = "id", names: DataFrame | None = None) -> DataFrame:
    """The `k` rows of greatest `value`, ties by key; with `names` (key, name) a name column, "null" where unknown."""
    top = df.orderBy(F.desc(value), key).limit(k)
    if names is None:
        return top
    return top.join(names, key, "left").withColumn("name", F.coalesce("name", F.lit("null")))


def k_shell(edges: DataFrame, direction: str = "degree", weighted: bool = False, max_shell: int | None = None) -> DataFrame:
    """(id, shell): vertices are peeled while their (remaining) degree is at most K, for K = 0, 1, 2, ...

    `direction` is `degree` or `indegree`; with `weighted` a degree sums edge weights. K jumps to the least remaining
    degree, so that empty shells cost nothing. With `max_shell` the vertices left above it get null.
    """
    vertices = cut(degrees(edges).select("id"))
    e = edges.groupBy("src", "dst").agg(F.sum(F.col("weight") if weighted else F.lit(1.0)).alias("w"))
    left = cut(e)
    shells: DataFrame | None = None
    k = 0.0
    while True:
        ends = left.select(F.col("dst").alias("id"), "w")
        if direction == "degree":
            ends = ends.union(left.select(F.col("src").alias("id"), "w"))
        d = cut(vertices.join(ends.groupBy("id").agg(F.sum("w").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")))
        least = d.agg(F.min("d")).first()[0]
        if least is None:
            break
        k = max(k, float(int(-(-least // 1))))
        if max_shell is not None and k > max_shell:
            rest = d.select("id", F.lit(None).cast("int").alias("shell"))
            shells = rest if shells is None else shells.union(rest)
            break
        out = d.filter(F.col("d") <= k).select("id")
        now = out.select("id", F.lit(int(k)).alias("shell"))
        shells = now if shells is None else shells.union(now)
        vertices = cut(d.join(out, "id", "left_anti").select("id"))
        left = cut(left.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return shells if shells is not None else vertices.withColumn("shell", F.lit(0))


def influence(edges: DataFrame, seeds: list, threshold: float = 0.8, runs: int = 1, max_rounds: int = 200, seed: int = 42) -> DataFrame:
    """(round, activated): independent cascades from `seeds`, mean number of vertices activated in each round.

    A newly active vertex activates each neighbour whose draw for (run, edge) reaches `threshold`; a vertex is
    activated once. All runs go at once, told apart by a column; draws are hashes of (seed, run, edge), so that a lost
    task repeats them. With a threshold of 0 the rounds are breadth-first levels.
    """
    spark = edges.sparkSession
    e = staged(edges.select("src", "dst").distinct(), "cascade")
    kind = dict(edges.dtypes)["src"]
    start = spark.createDataFrame([(s,) for s in seeds], "id long").select(F.col("id").cast(kind).alias("id"))
    seen = cut(start.distinct().crossJoin(spark.range(runs).select(F.col("id").alias("run"))))
    front = seen
    counts: list[tuple[int, float]] = []
    for k in range(1, max_rounds + 1):
        draw = uniform(F.concat_ws("/", F.lit(str(seed)), F.col("run").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string")))
        hit = front.withColumnRenamed("id", "src").join(e, "src").filter(draw >= threshold).select(F.col("dst").alias("id"), "run").distinct()
        front = cut(hit.join(seen, ["id", "run"], "left_anti"))
        n = front.count()
        if n == 0:
            break
        counts.append((k, n / runs))
        seen = cut(seen.union(front))
    return spark.createDataFrame(counts, "round int, activated double")


def adjacency_rank(edges: DataFrame) -> DataFrame:
    """(id, neighbours, place): distinct neighbours of every vertex and its place by their number, ties alike."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    d = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"))
    sizes = d.groupBy("neighbours").count()
    above = F.coalesce(F.sum("count").over(Window.orderBy(F.desc("neighbours")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(sizes.select("neighbours", (above + 1).alias("place")), "neighbours").select("id", "neighbours", "place")
