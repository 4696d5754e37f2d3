"""Problem 3."""
import datetime as dt
import random

import pytest

from silexa.llm.topn import top_n


def brute(data, n):
    by = {}
    for g, s, i in data:
        if g is not None:
            by.setdefault(g, set()).add((s, i))
    out = []
    for g, xs in by.items():
        key = lambda x: (0 if x[0] is None or x[0] != x[0] else 1, 0 if x[0] is None or x[0] != x[0] else x[0], -x[1])
        out += [(g, i) for s, i in sorted(xs, key=key, reverse=True)[:n]]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_against_sorting(spark, n):
    rng = random.Random(n)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 40), rng.choice([0.5, 1.0, 1.5, 4.5, 5.0, 4.25]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, s double, i int")
    got = sorted((r["g"], r["i"]) for r in top_n(df, "g", [("s", True), ("i", False)], n).collect())
    assert got == brute(data, n)


def test_continuous_scores_and_a_hot_group(spark):
    rng = random.Random(1)
    data = [(1 if i % 3 else i, rng.gauss(0, 1e6), i) for i in range(6000)]
    df = spark.createDataFrame(data, "g int, s double, i int")
    got = sorted((r["g"], r["i"]) for r in top_n(df, "g", [("s", True), ("i", False)], 7).collect())
    assert got == brute(data, 7)


def test_nulls_nan_infinities_and_repeats(spark):
    data = [(1, None, 1), (1, float("nan"), 2), (1, 3.0, 3), (1, 3.0, 3), (None, 9.0, 4), (2, float("inf"), 5), (2, 1.0, 6), (2, float("-inf"), 7), (3, None, 8)]
    df = spark.createDataFrame(data, "g int, s double, i int")
    got = sorted((r["g"], r["i"]) for r in top_n(df, "g", [("s", True), ("i", False)], 2).collect())
    assert got == [(1, 1), (1, 3), (2, 5), (2, 6), (3, 8)]  # the repeated row counts once; null and NaN rank last, by id


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 4, "x"), (1, 5.0, 6, 7, "y")], "c int, lo double, k int, w0 int, row string")
    out = top_n(df, "c", [("lo", True), ("k", False)], 1)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, 5.0, 6, 7, "y")]
    assert top_n(df.limit(0), "c", [("lo", True), ("k", False)], 1).count() == 0


def test_times_and_all_ties(spark):
    t = dt.datetime(2024, 1, 1)
    data = [(1, 1.0, t + dt.timedelta(microseconds=i % 5), i) for i in range(50)]
    df = spark.createDataFrame(data, "g int, s double, t timestamp, i bigint")
    got = [r["i"] for r in top_n(df, "g", [("s", True), ("t", True), ("i", False)], 4).orderBy("i").collect()]
    assert got == [4, 9, 14, 19]


def test_extreme_identifiers(spark):
    data = [(1, 0.0, -(2**63)), (1, 0.0, 2**63 - 1), (1, 0.0, 0)]
    df = spark.createDataFrame(data, "g int, s double, i bigint")
    assert [r["i"] for r in top_n(df, "g", [("s", True), ("i", False)], 2).orderBy("i").collect()] == [-(2**63), 0]


def test_text_has_no_numeric_order(spark):
    with pytest.raises(TypeError):
        top_n(spark.createDataFrame([(1, "a")], "g int, s string"), "g", [("s", True)], 1)
