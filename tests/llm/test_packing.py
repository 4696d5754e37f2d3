"""Problem 8."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from silexa.llm import packing
from silexa.llm.queries_packing import vocabulary_file


def naive(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fit = [(b, i) for i, b in enumerate(bins) if b >= s]
        if fit:
            _, i = min(fit, key=lambda x: x[0])
        else:
            bins.append(capacity)
            i = len(bins) - 1
        bins[i] -= s
        out.append(i)
    return bins, out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_a_scan(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 101 if seed < 5 else 30, 400))[::-1]
    size, n = np.unique(sizes, return_counts=True)
    runs = packing.best_fit_decreasing(dict(zip(size.tolist(), n.tolist())), 100)
    room = {}
    for s, _, count, each, lo in runs.tolist():
        for i in range(count):
            room[lo + i // each] = room.get(lo + i // each, 100) - s
    bins, _ = naive(sizes.tolist(), 100)
    assert sorted(room.values()) == sorted(bins)  # the same room left, whichever of equal bins is taken
    for s, c in zip(size.tolist(), n.tolist()):
        mine = sorted((f, k) for t, f, k, *_ in runs.tolist() if t == s)
        assert mine[0][0] == 0 and sum(k for _, k in mine) == c and all(f + k == g for (f, k), (g, _) in zip(mine, mine[1:]))


def test_work_depends_on_sizes_not_on_items():
    runs = packing.best_fit_decreasing({s: 10**9 + s for s in range(1, 2049)}, 2048)
    assert len(runs) < 50_000 and runs[:, 2].sum() == sum(10**9 + s for s in range(1, 2049))


def check(items, out, capacity):
    """Every item whole and once, no container too full."""
    by, fill = {}, {}
    for r in out:
        by.setdefault(r["id"], []).append((r["piece"], r["start"], r["length"]))
        fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
    assert set(by) == set(items)
    for k, n in items.items():
        pieces = sorted(by[k])
        assert sum(p[2] for p in pieces) == max(n or 0, 0)
        assert [p[1] for p in pieces] == [i * capacity for i in range(len(pieces))]
        assert len(pieces) == 1 or n > capacity
    assert max(fill.values()) <= capacity
    return fill


def test_whole_items_and_little_room(spark):
    rng = np.random.default_rng(3)
    items = {i: int(n) for i, n in enumerate(np.minimum(rng.lognormal(4.5, 1.1, 5000), 9000))}
    df = spark.createDataFrame([(k, n, "x") for k, n in items.items()] * 2, "id bigint, n int, bin string")  # repeated rows
    fill = check(items, packing.pack(df, "id", "n", 512).collect(), 512)
    assert sum(fill.values()) / (len(fill) * 512) > 0.98


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 3)
    items = {f"k{i}": 1 + (i * 37) % 100 for i in range(2000)}
    df = spark.createDataFrame(list(items.items()), "id string, n int")
    fill = check(items, packing.pack(df, "id", "n", 100).collect(), 100)
    bins, _ = naive(sorted(items.values(), reverse=True), 100)
    assert sorted(100 - f for f in fill.values()) == sorted(bins)  # however many parts number the items


def test_odd_sizes(spark):
    items = {1: None, 2: 0, 3: -5, 4: 100, 5: 101, 6: 1000, 7: 1, 8: 100}
    df = spark.createDataFrame([*items.items(), (None, 5)], "id int, n int")
    check(items, packing.pack(df, "id", "n", 100).collect(), 100)
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


@pytest.mark.skipif(not os.path.exists(vocabulary_file()), reason="no public tokenizer here")
def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 5000)], "doc_id int, text string").withColumn("id", F.lit("x"))
    n = {r["doc_id"]: r["n_tokens"] for r in packing.token_lengths(df, "doc_id", "text", vocabulary_file()).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1 and 5000 <= n[5] <= 5002
