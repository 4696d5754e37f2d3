"""Problem 4."""
import math

import numpy as np
from pyspark.sql import functions as F

from silexa.llm import quantiles as q


def rank_error(values, got, p):
    """How far the returned value's ranks lie from the wanted rank, as a share."""
    x = np.sort(values)
    lo, hi = np.searchsorted(x, got, "left"), np.searchsorted(x, got, "right")
    want = p * len(x)
    return 0 if lo <= want <= hi else min(abs(lo - want), abs(hi - want)) / len(x)


def test_buffers_bound_the_rank_error():
    rng = np.random.default_rng(5)
    b = q.Buffers()
    values = rng.lognormal(0, 2, 300_000)
    for part in np.array_split(values, 97):
        b.add(part)
    points = sorted((v, 2**level) for level, vals in b.rows() for v in vals)
    assert sum(w for _, w in points) == len(values)  # weights are kept exactly
    for p in (0.01, 0.25, 0.5, 0.9, 0.999):
        run = 0
        for v, w in points:
            run += w
            if run >= math.ceil(p * len(values)):
                break
        assert rank_error(values, v, p) < 0.002


def test_percentiles_exact_for_small_groups(spark):
    rng = np.random.default_rng(2)
    data = [(int(g), float(np.round(v, 1))) for g, v in zip(rng.integers(0, 9, 3000), rng.normal(50, 9, 3000))]
    df = spark.createDataFrame(data, "lot int, v double")
    out = {r["lot"]: r for r in q.percentiles(q.sketch(df, ["lot"], "v"), ["lot"], [0.1, 0.5, 0.9]).collect()}
    for lot in range(9):
        x = sorted(v for g, v in data if g == lot)
        assert out[lot]["n"] == len(x)
        assert out[lot]["q"] == [x[math.ceil(p * len(x)) - 1] for p in (0.1, 0.5, 0.9)]


def test_days_combine_and_a_hot_group(spark):
    df = spark.range(60_000).select((F.col("id") % 3 > 0).cast("int").alias("g"), (F.col("id") % 7).cast("int").alias("day"), ((F.col("id") * 7919) % 60_013).cast("double").alias("v"))
    daily = q.sketch(df, ["g", "day"], "v")
    both = {r["g"]: r for r in q.percentiles(q.merge(daily, ["g"]), ["g"], [0.25, 0.5, 0.75]).collect()}
    for g in (0, 1):
        x = np.array([r[0] for r in df.filter(F.col("g") == g).select("v").collect()])
        assert both[g]["n"] == len(x)
        for p, v in zip((0.25, 0.5, 0.75), both[g]["q"]):
            assert rank_error(x, v, p) < 0.005


def test_nulls_nan_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (1, float("nan"), 5, "x"), (1, 2.0, 5, "x"), (None, 3.0, 5, "y"), (2, None, 5, "z")], "g int, v double, level int, vals string")
    out = {r["g"]: (r["n"], r["q"]) for r in q.percentiles(q.sketch(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert out == {1: (1, [2.0]), None: (1, [3.0])}


def test_empty(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert q.percentiles(q.sketch(df, ["g"], "v"), ["g"], [0.5]).count() == 0
