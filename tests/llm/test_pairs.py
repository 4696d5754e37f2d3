"""Problem 6."""
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from silexa.llm import pairs


def brute(data, least, lift):
    baskets = {}
    for u, i in data:
        if u is not None and i is not None:
            baskets.setdefault(u, set()).add(i)
    n = len(baskets)
    na = Counter(i for b in baskets.values() for i in b)
    c = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {p: (k, na[p[0]], na[p[1]]) for p, k in c.items() if k >= least and k * n / (na[p[0]] * na[p[1]]) >= lift}


@pytest.mark.parametrize("seed,least,lift", [(1, 3, 1.0), (2, 2, 1.5), (3, 8, 1.0)])
def test_against_brute_force(spark, seed, least, lift):
    rng = random.Random(seed)
    data = []
    for u in range(150):
        size = 300 if u == 0 else 120 if u == 1 else rng.randrange(1, 15)  # large baskets are left out, their bits added
        data += [(u, rng.randrange(320)) for _ in range(size)]
    data += [(u, i) for u in range(20, 50) for i in (5, 6)] + data[:40] + [(None, 1), (3, None)]
    df = spark.createDataFrame([(u, i, "x") for u, i in data], "u int, i int, na string")
    got = {(r["item_a"], r["item_b"]): (r["together"], r["n_a"], r["n_b"]) for r in pairs.items_together(df, "u", "i", least, lift, min_llr=-1e9).collect()}
    assert got == brute(data, least, lift)


def test_blocks_of_a_large_basket(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_BLOCK", 16)
    data = [(u, i) for u in range(4) for i in range(u, 70)]
    df = spark.createDataFrame(data, "u int, i int")
    got = {(r["item_a"], r["item_b"]): (r["together"], r["n_a"], r["n_b"]) for r in pairs.items_together(df, "u", "i", 1, 0.1, min_llr=-1e9).collect()}
    assert got == brute(data, 1, 0.1)


def test_heavy_items_are_split():
    codes = np.array(sorted((7 << 32) | b for b in range(8, 1200)), np.int64)
    batch = pairs._stripes(codes, np.ones(len(codes), np.int64), np.array([7]))
    assert set(batch.column("part").to_pylist()) == set(range(16))
    merged = [r for b in pairs._merge(1)(iter([batch])) for r in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert sorted(merged) == [(7, b) for b in range(8, 1200)]


def test_log_likelihood_ratio(spark):
    df = spark.createDataFrame([(10, 12, 15, 1000), (5, 5, 5, 5)], "c bigint, a bigint, b bigint, n bigint")
    got = [r[0] for r in df.select(pairs.log_likelihood_ratio(df.c, df.a, df.b, df.n)).collect()]

    def g2(c, a, b, n):
        cells = [(c, a * b), (a - c, a * (n - b)), (b - c, (n - a) * b), (n - a - b + c, (n - a) * (n - b))]
        return 2 * sum(o * math.log(o * n / e) for o, e in cells if o)

    assert got[0] == pytest.approx(g2(10, 12, 15, 1000)) and got[1] == pytest.approx(0.0)


def test_empty(spark):
    assert pairs.items_together(spark.createDataFrame([], "u int, i int"), "u", "i").count() == 0
