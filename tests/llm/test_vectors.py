"""Problems 1 and 7."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from silexa.llm import clusters, components, neighbours, vectors

SCHEMA = "key string, idx array<int>, val array<double>, cls string, other int"


def near_copies(rng, groups, size, width=400, nnz=15, noise=0.08):
    """Groups of vectors of cosine well above 0.94, and single ones."""
    out = []
    for g in range(groups):
        idx = rng.choice(width, nnz, replace=False)
        base = rng.uniform(0.2, 1.0, nnz)
        for k in range(size if g % 2 else 1):
            out.append((f"k{g:03d}-{k}", idx, base * (1 + rng.normal(0, noise, nnz))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, [int(x) for x in i], [float(x) for x in v], "x", 1) for k, i, v in rows], SCHEMA)


def brute(rows, k, least):
    width = max(int(max(i)) for _, i, _ in rows) + 1
    x = np.zeros((len(rows), width))
    for r, (_, i, v) in enumerate(rows):
        x[r, i] = v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for r, (key, _, _) in enumerate(rows):
        c = [j for j in range(len(rows)) if j != r and s[r, j] >= least]
        out[key] = [rows[j][0] for j in sorted(c, key=lambda j: (-s[r, j], rows[j][0]))[:k]]
    return out


def test_canonical_forms(spark):
    data = [
        ("a", [3, 1, 2], [3.0, 0.0, 4.0]), ("b", [2, 3], [8.0, 6.0]), ("b", None, None), ("c", [], []), ("d", [1], [0.0]), ("e", [1, 2, 9], [1.0, float("nan")]), ("f", [4, 4], [1.0, 1.0]),
        (None, [1], [1.0]), ("g", [-1, 5], [1.0, 2.0]), ("h", [1, None], [None, 2.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    out = {r["key"]: r for r in vectors.canonical(df, "key", "idx", "val").collect()}
    assert set(out) == {"a", "b", "e", "f", "g"}
    assert list(out["a"]["idx"]) == [2, 3] and out["a"]["cls"] == out["b"]["cls"]  # the same direction
    assert list(out["e"]["idx"]) == [1] and list(out["f"]["idx"]) == [4] and list(out["g"]["idx"]) == [5]


def test_dots():
    a = (np.array([0, 2, 2, 3]), np.array([1, 5, 7]), np.array([1.0, 2.0, 3.0]))
    b = (np.array([0, 1, 2, 4]), np.array([5, 1, 6, 7]), np.array([4.0, 9.0, 1.0, 2.0]))
    assert vectors.dots(a, b).tolist() == [8.0, 0.0, 6.0]


def test_plan_grows_with_the_collection():
    small, large = neighbours.plan(1000, 0.94, 0.005), neighbours.plan(10**8, 0.94, 0.005)
    assert large[1] > small[1] and large[0] > small[0] and small[2] < small[0] * small[1]


def test_recall_against_brute_force(spark):
    rows = near_copies(np.random.default_rng(7), 120, 5)
    got = {}
    for r in neighbours.most_similar(frame(spark, rows), "key", "idx", "val", 3, 0.94).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["other"]))
    want = brute(rows, 3, 0.94)
    hits = sum(len({o for _, o in got.get(k, [])} & set(v)) for k, v in want.items())
    total = sum(map(len, want.values()))
    assert total > 100 and hits / total >= 0.98
    assert all(sorted(x for x, _ in v) == list(range(1, len(v) + 1)) for v in got.values())


@pytest.mark.parametrize("block", [8192, 100])
def test_a_mass_of_near_copies(spark, monkeypatch, block):
    """All vectors within a cone: every bucket is large, and each vector still finds its true nearest, by id."""
    monkeypatch.setattr(neighbours, "HOT", 16)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    base, idx = rng.uniform(0.5, 1.0, 12), list(range(0, 120, 10))
    rows = [(f"m{i:03d}", idx, base * (1 + rng.normal(0, 0.05, 12))) for i in range(400)] + near_copies(rng, 10, 4)
    got = {}
    for r in neighbours.most_similar(frame(spark, rows), "key", "idx", "val", 5, 0.94).collect():
        got.setdefault(r["key"], []).append(r["other"])
    want = brute(rows, 5, 0.94)
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) >= 0.99 * sum(map(len, want.values()))
    assert all(len(got[f"m{i:03d}"]) == 5 for i in range(400))


def test_spaces_never_meet(spark):
    """Collections searched in one go give what each gives alone, also where they hold the same vectors."""
    rows = near_copies(np.random.default_rng(13), 40, 4)
    both = frame(spark, rows).withColumn("side", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit(None))))
    got = {(r["side"], r["key"], r["other"], r["rank"]) for r in neighbours.most_similar(both, "key", "idx", "val", 3, 0.94, space="side").collect()}
    alone = {(r["key"], r["other"], r["rank"]) for r in neighbours.most_similar(frame(spark, rows), "key", "idx", "val", 3, 0.94).collect()}
    assert got == {(s, *x) for s in "xy" for x in alone}


def test_every_index_has_its_own_projection():
    a, b = neighbours._gauss(np.array([3, 2**40]), 4000), neighbours._gauss(np.array([2**40, 3]), 4000)
    assert (a == b[::-1]).all() and abs(np.corrcoef(a)[0, 1]) < 0.06 and abs(a.mean()) < 0.03 and abs(a.std() - 1) < 0.03


@pytest.mark.parametrize("probe", [0, 1, 2])
def test_probing_finds_the_same_pairs(spark, probe):
    rows = near_copies(np.random.default_rng(8), 60, 4)
    v = vectors.classes(vectors.canonical(frame(spark, rows), "key", "idx", "val"))
    pairs = {(r["cls"], r["near"]) for r in neighbours.similar_classes(v, 0.94, probe=probe).collect() if r["cls"] < r["near"]}
    want = sum(len(x) for x in brute(rows, 99, 0.94).values()) // 2
    assert len(pairs) >= 0.98 * want > 50
    assert neighbours.plan(10**5, 0.94, 0.005, 1)[0] < neighbours.plan(10**5, 0.94, 0.005, 0)[0]


def test_many_copies_stay_bounded(spark):
    one = ("", [1, 2, 3], [1.0, 2.0, 3.0])
    rows = [(f"c{i:03d}", one[1], [v * (i + 1) for v in one[2]]) for i in range(200)] + near_copies(np.random.default_rng(1), 6, 3)
    got = {}
    for r in neighbours.most_similar(frame(spark, rows), "key", "idx", "val", 4, 0.94).collect():
        got.setdefault(r["key"], []).append(r["other"])
    copies = {k: sorted(v) for k, v in got.items() if k.startswith("c")}
    assert len(copies) == 200
    assert copies["c199"] == ["c000", "c001", "c002", "c003"] and copies["c001"] == ["c000", "c002", "c003", "c004"]


def test_neighbours_of_nothing(spark):
    assert neighbours.most_similar(spark.createDataFrame([], SCHEMA), "key", "idx", "val").count() == 0
    zero = spark.createDataFrame([("a", [1], [0.0], "x", 1), ("b", None, None, "x", 1)], SCHEMA)
    assert neighbours.most_similar(zero, "key", "idx", "val").count() == 0


@pytest.mark.parametrize("block", [8192, 64])
def test_every_vector_gets_its_k_nearest(spark, monkeypatch, block):
    """Also vectors whose nearest are far below the least cosine, or share no index with them."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = near_copies(np.random.default_rng(11), 60, 5) + [("lone", [900], [1.0]), ("twin", [900], [2.0])]
    got = {}
    for r in neighbours.most_similar(frame(spark, rows), "key", "idx", "val", 10, 0.94, complete=True).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["other"], r["cosine"]))
    x = np.zeros((len(rows), 901))
    for r, (_, i, v) in enumerate(rows):
        x[r, i] = np.asarray(v) / np.linalg.norm(v)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert len(got) == len(rows) and all(sorted(a for a, _, _ in v) == list(range(1, 11)) for v in got.values())
    for r, (key, _, _) in enumerate(rows):
        assert np.allclose(sorted((c for _, _, c in got[key]), reverse=True), np.sort(s[r])[::-1][:10], atol=1e-6)
    assert [o for _, o, _ in sorted(got["lone"])] == ["twin", *sorted(k for k, _, _ in rows if k not in ("lone", "twin"))[:9]]


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "LINKS", most)
    pairs = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (6, 7), (20, 22), (21, 22)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["cls"]: r["comp"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 8)}, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    assert components.connected_components(links.limit(0)).count() == 0


def points(spark, groups):
    """Records on a line, in one space."""
    df = spark.createDataFrame(groups, "key string, x double")
    return df.select("key", F.lit(0).cast("bigint").alias("space"), F.xxhash64("x").alias("cls"), F.array(F.lit(0)).cast("array<bigint>").alias("idx"), F.array("x").alias("val"))


LINE = clusters.Measure("euclid", strict=1.0, loose=1.1, jaccard=0.4, cell=0.1, reach=15)


def test_tight_groups_and_typical_members(spark):
    r = points(spark, [("a", 0.0), ("b", 0.5), ("c", 0.5), ("d", 0.9), ("e", 9.0), ("f", 9.2), ("g", 30.0)])
    members, groups = clusters.similarity_clusters(r, LINE)
    assert {x["key"]: x["cluster"] for x in members.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}
    g = {x["cluster"]: x for x in groups.collect()}
    assert (g["a"]["size"], g["e"]["size"], g["g"]["size"]) == (4, 2, 1) and all(x["whole"] for x in g.values())
    assert g["a"]["typical"][0] == "b"


def test_loose_chain_is_split_around_medoids(spark):
    r = points(spark, [(f"k{i:02d}", i * 0.9) for i in range(12)])
    members, groups = clusters.similarity_clusters(r, LINE)
    by = {}
    for x in members.collect():
        assert not x["whole"]
        by.setdefault(x["cluster"], []).append(int(x["key"][1:]))
    assert sorted(i for v in by.values() for i in v) == list(range(12))
    assert all(max(v) - min(v) <= 2 for v in by.values())  # a medoid and the records within 1.0 of it
    assert groups.agg(F.sum("size")).first()[0] == 12


@pytest.mark.parametrize("block", [512, 40])
def test_a_dense_component_is_split_by_all_its_pairs(spark, monkeypatch, block):
    """Candidates hold few of a dense component's pairs; medoids, members and typical ones go by all of them."""
    monkeypatch.setattr(clusters, "BLOCK", block)
    xs = sorted(set(np.random.default_rng(12).uniform(0, 4, 300).round(3).tolist()))
    r = points(spark, [(f"k{i:03d}", x) for i, x in enumerate(xs)])
    cls = {x["key"]: x["cls"] for x in r.select("key", "cls").collect()}
    keys = [f"k{i:03d}" for i in range(len(xs))]
    far = np.abs(np.subtract.outer(xs, xs))
    left, want = set(range(len(xs))), {}
    while left:
        rank = {i: (sum(far[i, j] <= 1 + 1e-9 for j in left), cls[keys[i]]) for i in left}
        near = {i: [j for j in left if j != i and far[i, j] <= 1 + 1e-9] for i in left}
        heads = {i for i in left if all(rank[i] > rank[j] for j in near[i])}
        for i in list(left):
            at = [i] if i in heads else [j for j in near[i] if j in heads]
            if at:
                want.setdefault(max(at, key=rank.get), set()).add(i)
        left -= set().union(*want.values())
    members, groups = clusters.similarity_clusters(r, LINE)
    by = {}
    for x in members.collect():
        by.setdefault(x["cluster"], set()).add(int(x["key"][1:]))
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    for g in groups.collect():
        inside = sorted(by[g["cluster"]])
        total = {i: sum(far[i, j] for j in inside) for i in inside}
        assert [total[int(k[1:])] for k in g["typical"]] == pytest.approx(sorted(total.values())[:3])


def test_blocks_give_the_same_degrees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xs = rng.uniform(0, 1.5, 60).round(2)
    parts = points(spark, [(f"k{i}", float(x)) for i, x in enumerate(sorted(set(xs)))]).select(F.lit(1).cast("bigint").alias("comp"), "cls", F.lit(2).cast("bigint").alias("weight"), "idx", "val")
    whole = {r["cls"]: r["similar"] for r in clusters.exact_degrees(parts, LINE).collect()}
    monkeypatch.setattr(clusters, "BLOCK", 7)
    assert {r["cls"]: r["similar"] for r in clusters.exact_degrees(parts, LINE).collect()} == whole


def test_clusters_of_copies_and_of_nothing(spark):
    r = points(spark, [(f"k{i}", 1.0) for i in range(50)])
    members, groups = clusters.similarity_clusters(r, LINE)
    g = groups.collect()
    assert len(g) == 1 and g[0]["size"] == 50 and g[0]["cluster"] == "k0" and members.count() == 50
    members, groups = clusters.similarity_clusters(r.limit(0), LINE)
    assert members.count() == 0 and groups.count() == 0


def by_cosine(spark, rows):
    return vectors.canonical(frame(spark, rows), "key", "idx", "val").select("key", F.lit(0).cast("bigint").alias("space"), "cls", "idx", "val")


def test_cosine_groups(spark):
    rows = near_copies(np.random.default_rng(9), 20, 6)
    members, _ = clusters.similarity_clusters(by_cosine(spark, rows), clusters.Measure("cosine", strict=0.9, loose=0.8, jaccard=0.5))
    assert all(r["cluster"][:4] == r["key"][:4] for r in members.collect())
    assert members.select("cluster").distinct().count() == 20


def test_one_heavy_index_makes_a_group(spark):
    """Records that share a heavy index and have light tails of their own have a cosine of 0.93, whatever their sets of indices."""
    rows = [(f"a{i}", [0, *range(10 * i + 1, 10 * i + 9)], [1.0] + [0.095] * 8) for i in range(6)] + [(f"b{i}", [500, *range(600 + 10 * i, 608 + 10 * i)], [-1.0] + [0.095] * 8) for i in range(5)]
    members, groups = clusters.similarity_clusters(by_cosine(spark, rows), clusters.Measure("cosine", strict=0.6, loose=0.5, jaccard=0.3))
    assert {r["key"]: r["cluster"] for r in members.collect()} == {k: k[0] + "0" for k, _, _ in rows}
    assert {(r["cluster"], r["size"], r["whole"]) for r in groups.collect()} == {("a0", 6, True), ("b0", 5, True)}


def test_minima_agree_as_often_as_the_jaccard_similarity():
    rng = np.random.default_rng(3)
    pairs, m = 400, clusters.Measure("cosine", 0.6, 0.5, 0.3)
    x = rng.uniform(0.1, 1, (2 * pairs, 6))
    idx = np.concatenate([np.sort(rng.choice(9, 6, replace=False)) for _ in range(2 * pairs)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = (np.arange(2 * pairs + 1) * 6, idx, x.ravel())
    h = m.minima(np.zeros(2 * pairs, np.int64), v, rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1))
    half = lambda k: (np.arange(pairs + 1) * 6, idx.reshape(-1, 6)[k * pairs : (k + 1) * pairs].ravel(), x[k * pairs : (k + 1) * pairs].ravel())
    want = m.token_jaccard(half(0), half(1), np.ones(pairs, bool))
    got = (h[:, :pairs] == h[:, pairs:]).mean(0)
    assert abs(got.mean() - want.mean()) < 0.02 and np.corrcoef(got, want)[0, 1] > 0.9
    c = vectors.dots(half(0), half(1))
    assert (want >= (1 - np.sqrt(1 - c**2)) / (1 + np.sqrt(1 - c**2)) - 1e-9).all()  # the floor


@pytest.mark.parametrize("few,block", [(16, 1024), (1, 1024), (1, 20)])
def test_components_lose_no_link(spark, monkeypatch, few, block):
    """Components equal those of all loosely similar pairs, however dense the buckets are and however they are cut."""
    monkeypatch.setattr(clusters, "FEW", few)
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(6)
    xs = np.unique(np.r_[rng.uniform(0, 3, 150), rng.uniform(5, 5.5, 100), np.cumsum(rng.uniform(0.9, 1.3, 60)) + 10].round(4))
    r = points(spark, [(f"k{i:03d}", float(x)) for i, x in enumerate(xs)])
    sets = r.select("cls", "space", "idx", "val")
    comp = {x["cls"]: x["comp"] for x in clusters.components_of(sets, LINE).collect()}
    got = [comp[x["cls"]] for x in r.orderBy("key").collect()]
    assert [a == b for a, b in zip(got, got[1:])] == (np.diff(xs) <= 1.1 + 1e-9).tolist() and len(set(got)) == 1 + (np.diff(xs) > 1.1 + 1e-9).sum()


def test_isolated(spark):
    pos = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 0.5, 0.0, "a"), (1, 1.5, 0.0, "b"), (1, 9.0, 9.0, "c"), (2, 0.2, 0.0, "d")], "space int, x double, y double, cluster string")
    out = clusters.isolated(pos.filter("cluster IN ('a', 'c')"), pos, 1.1)
    assert {r["cluster"] for r in out.collect()} == {"c"}
