import numpy as np
import pytest
from pyspark.sql import functions as F

from silexa.functions import vectors as vec
from silexa.operators import gradient, graph, ml, trees
from silexa.operators.iforest import IsolationForest, IsolationForestModel, path_correction

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 3), (5, 3), (6, 7)]


@pytest.fixture(scope="module")
def edges(spark):
    return graph.load_edges(spark.createDataFrame([*EDGES, (None, 1)], "a bigint, b bigint"), "a", "b")


def test_pagerank_keeps_its_mass(edges):
    got = {r["id"]: r["rank"] for r in graph.pagerank(edges, rounds=7).collect()}
    ids = sorted({x for e in EDGES for x in e})
    n, r = len(ids), dict.fromkeys(ids, 1 / len(ids))
    out = {i: sum(a == i for a, _ in EDGES) for i in ids}
    for _ in range(7):
        s = sum(r[i] for i in ids if not out[i])
        r = {v: 0.85 * sum(r[a] / out[a] for a, b in EDGES if b == v) + 0.15 * (1 - s) / n + s / n for v in ids}
    assert sum(got.values()) == pytest.approx(1.0) and all(got[i] == pytest.approx(r[i]) for i in ids)


def test_reverse_and_top(edges, spark):
    assert {(r["src"], r["dst"]) for r in graph.load_edges(edges, reverse=True).collect()} == {(b, a) for a, b in EDGES}
    names = spark.createDataFrame([(3, "three")], "id bigint, name string")
    top = graph.top_k(graph.degrees(edges), "degree", 2, names=names).orderBy(F.desc("degree"), "id").collect()
    assert [(r["id"], r["degree"], r["name"]) for r in top] == [(3, 5, "three"), (1, 2, "null")]


def test_k_shell(spark):
    clique = [(a, b) for a in range(4) for b in range(a)]
    e = graph.load_edges(spark.createDataFrame([*clique, (10, 0), (11, 10)], "src bigint, dst bigint"))
    assert {r["id"]: r["shell"] for r in graph.k_shell(e).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 10: 1, 11: 1}


def test_influence_levels(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 1), (9, 1)], "src bigint, dst bigint")
    assert [(r["round"], r["activated"]) for r in graph.influence(e, [1], 0.0).orderBy("round").collect()] == [(1, 2.0), (2, 1.0)]
    assert graph.influence(e, [1], 1.1).count() == 0
    some = {r["round"]: r["activated"] for r in graph.influence(e, [1], 0.5, runs=200).collect()}
    assert abs(some[1] - 1.0) < 0.2


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 2))
    x[:8] += 9
    return spark.createDataFrame([(i, float(a), float(b), float((a > 0) + (a > 0 and b > 0)), float(3 * a - b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double, c double, t double")


def test_isolation_forest(numbers, tmp_path, spark):
    m = IsolationForest(num_trees=30, max_samples=128, contamination=0.02, seed=1).fit(numbers, ["x", "y"], "id")
    out = m.transform(numbers)
    assert {r["id"] for r in out.filter("prediction = 1").collect()} == set(range(8))
    m.save(str(tmp_path / "forest"))
    again = IsolationForestModel.load(spark, str(tmp_path / "forest"))
    assert again.threshold == m.threshold and again.summary(numbers).first()["anomalies"] == 8
    assert path_correction(2) == 1.0 and path_correction(1) == 0.0 and path_correction(256) == pytest.approx(10.244, abs=1e-3)


def test_forest_on_constant_features(spark):
    d = spark.createDataFrame([(i, 1.0) for i in range(20)], "id int, x double")
    assert IsolationForest(num_trees=3).fit(d, ["x"], "id").score(d).select("anomaly_score").distinct().count() == 1


def test_cart_classes_and_expression(numbers):
    tree = trees.CART("gini", 4, 32, 5).fit(numbers, ["x", "y"], "c")
    ok = numbers.withColumn("p", trees.tree_expression(tree, ["x", "y"])).agg(F.avg((F.col("p") == F.col("c")).cast("double"))).first()[0]
    assert ok > 0.93 and tree.depth() <= 4 and "if x <" in trees.print_tree(tree, ["x", "y"])
    assert trees.feature_gain(tree, ["x", "y"])["x"] > 0


def test_nulls_are_scored_as_they_are_trained(spark):
    """Null and NaN count as 0: rows of them get the mean of the leaf in which they were."""
    rows = [(None, 10.0)] * 20 + [(float("nan"), 10.0)] * 20 + [(1.0, 10.0)] * 40 + [(9.0, 90.0)] * 40
    d = spark.createDataFrame(rows, "x double, y double")
    tree = trees.CART("variance", 1).fit(d, ["x"], "y")
    assert {(r["y"], r["p"]) for r in d.withColumn("p", trees.tree_expression(tree, ["x"])).collect()} == {(10.0, 10.0), (90.0, 90.0)}
    assert tree.threshold == 5.0  # of few values all thresholds are tried, midway
    boosted, errors = trees.gbrt(d, ["x"], "y", trees.CART("variance", 1), 2, 1.0)
    assert errors[-1] == pytest.approx(0.0) and boosted.transform(d).filter("abs(prediction - y) > 1e-9").count() == 0
    many = trees.gbdt(d, ["x"], "y", trees.CART("variance", 1), 1)
    assert many.transform(d).filter("prediction <> y").count() == 0


def test_a_feature_may_be_called_like_any_column(spark):
    d = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 2), i % 7 > 3, 1.0) for i in range(200)], "y double, w double, tree double, leaf boolean, e double")
    tree = trees.CART("variance", 2).fit(d.withColumn("leaf", F.col("leaf").cast("double")), ["y", "w", "tree"], "leaf")
    assert (tree.feature, tree.threshold) == (0, 3.5) and tree.left.prediction == 0.0 and tree.right.prediction == 1.0


@pytest.mark.parametrize("kind", ["variance", "gini"])
def test_sparse_features_give_the_same_tree(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 4, (300, 6)) * (rng.random((300, 6)) < 0.4)
    y = (x[:, 1] > 0) * 2.0 + (x[:, 4] < 0)
    dense = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"f{i} double" for i in range(6)) + ", t double")
    names = [f"f{i}" for i in range(6)]
    pairs = [([int(i) for i in rng.permutation(6) if r[i] or i == 3], float(v), r) for r, v in zip(x, y)]
    sparse = spark.createDataFrame([(i, [float(r[k]) for k in i], v) for i, v, r in pairs], "idx array<int>, val array<double>, t double")
    a, b = trees.CART(kind, 3, 32, 5).fit(dense, names, "t"), trees.CART(kind, 3, 32, 5).fit(sparse, trees.Sparse("idx", "val", 6), "t")
    assert trees.print_tree(a, names) == trees.print_tree(b, names) and a.depth() > 1
    out = sparse.withColumn("p", trees.tree_expression(b, trees.Sparse("idx", "val", 6)))
    assert out.filter("p = t").count() > 250 or kind == "variance"


def test_forest_stage(numbers, tmp_path, spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from silexa.operators.iforest_ml import IForest, IForestModel

    model = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), IForest(numTrees=20, maxSamples=128.0, contamination=0.02, seed=1)]).fit(numbers)
    out = model.transform(numbers)
    assert {r["id"] for r in out.filter("prediction = 1").collect()} == set(range(8)) and {"anomalyScore", "features"} <= set(out.columns)
    model.stages[1].write().overwrite().save(str(tmp_path / "stage"))
    again = IForestModel.load(str(tmp_path / "stage"))
    assert again.getOrDefault("contamination") == 0.02 and again.summary(model.stages[0].transform(numbers)).first()["anomalies"] == 8
    with pytest.raises(ValueError, match="already"):
        again.transform(out)
    with pytest.raises(ValueError, match="missing"):
        again.transform(numbers)


def test_k_shell_against_peeling(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2)) if a != b}
    left, want, k = set(pairs), {}, 0
    ids = {x for p in pairs for x in p}
    while ids:
        degree = {i: sum(i in p for p in left) for i in ids}
        k = max(k, min(degree.values()))
        out = {i for i in ids if degree[i] <= k}
        want |= dict.fromkeys(out, k)
        ids -= out
        left = {p for p in left if not out & set(p)}
    e = graph.load_edges(spark.createDataFrame(list(pairs), "src bigint, dst bigint"))
    assert {r["id"]: r["shell"] for r in graph.k_shell(e).collect()} == want


def test_cart_with_one_value_is_a_leaf(spark):
    d = spark.createDataFrame([(1.0, float(i)) for i in range(40)], "x double, t double")
    tree = trees.CART().fit(d, ["x"], "t")
    assert tree.feature == -1 and tree.prediction == pytest.approx(19.5)


def test_ensembles(numbers):
    forest = trees.random_forest(numbers, ["x", "y"], "c", "id", trees.CART("gini", 3, 16, 5), 5, 0.8, 1.0)
    assert forest.transform(numbers).agg(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0] > 0.85
    boosted, errors = trees.gbrt(numbers, ["x", "y"], "t", trees.CART("variance", 3, 16), 4, 0.5, watch=numbers)
    assert errors == sorted(errors, reverse=True) and all(abs(a - b) < 1e-9 for a, b in errors)
    many = trees.gbdt(numbers, ["x", "y"], "c", trees.CART("variance", 2, 16), 3)
    assert many.transform(numbers).agg(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0] > 0.85


def test_gradients_lower_the_loss(numbers):
    f = numbers.select("id", F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"), F.array("x", "y"))).alias("fid", "v"))
    p = gradient.softmax_fit(f, numbers.select("id", F.col("c").alias("y")), 3, 1.0, 0.0, 12)
    ok = gradient.softmax_predict(f, p).join(numbers, "id").agg(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0]
    assert ok > 0.75
    m = gradient.fm_fit(f, numbers.select("id", F.col("t").alias("y")), True, 2, 0.05, 0.0, 0.0, max_iter=20)
    rmse = gradient.fm_predict(m, f).join(numbers, "id").agg(F.sqrt(F.avg((F.col("prediction") - F.col("t")) ** 2))).first()[0]
    assert rmse < 0.7 * numbers.agg(F.stddev("t")).first()[0]


def test_nmf_and_svd_feature(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0.2, 1.5, (12, 2)), rng.uniform(0.2, 1.5, (9, 2))
    r = spark.createDataFrame([(u, i, float(a[u] @ b[i])) for u in range(12) for i in range(9)], "user int, item int, rating double")
    w, h = gradient.nmf_fit(r, 2, 0.3, 0.0, 12, decay=False)
    out = gradient.nmf_predict(r, w, h)
    base, err = r.agg(F.stddev("rating")).first()[0], out.agg(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))).first()[0]
    assert err < base and w.filter("p0 < 0 OR p1 < 0").count() == 0
    cold = gradient.nmf_predict(spark.createDataFrame([(99, 0, 0.0)], "user int, item int, rating double"), w, h).first()
    assert cold["prediction"] > 0
    x = r.withColumn("id", F.concat_ws(" ", "user", "item"))
    u, i = x.select("id", F.col("user").cast("bigint").alias("fid"), F.lit(1.0).alias("v")), x.select("id", F.col("item").cast("bigint").alias("fid"), F.lit(1.0).alias("v"))
    m = gradient.svd_feature_fit(u, i, u.limit(0), x.select("id", F.col("rating").alias("y")), True, 2, 3.0, 0.0, 6)
    err = gradient.svd_feature_predict(m, u, i, u.limit(0)).join(x, "id").agg(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))).first()[0]
    assert err < base


def test_built_in_learners(numbers, spark):
    model, table = ml.pca_fit(numbers, ["x", "y", "t"], 2)
    rows = table.orderBy("row").collect()
    assert [r["row"] for r in rows] == [0, 1] and rows[1]["sum_explained"] == pytest.approx(1.0)
    assert ml.pca_transform(model, numbers).columns == ["col1", "col2"]
    assert "features" not in ml.gbt_predict(ml.gbt_regressor(numbers, ["x"], "t", 2, 2, "gini"), numbers).columns
    with pytest.raises(ValueError):
        ml.gbt_regressor(numbers, ["x"], "t", impurity="entropy")


def test_vector_functions(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], {1: 2.0, 2: 0.0}, {2: 1.0, 1: 3.0})], "a array<double>, z array<double>, m map<int,double>, n map<int,double>")
    r = d.select(
        vec.norm("a").alias("l2"), vec.cosine("a", "z").alias("cos"), vec.normalize("z").alias("nz"), vec.argmax("a").alias("am"), vec.top("a", 1).alias("top"), vec.equal("a", "a").alias("eq"), vec.sparse_dot("m", "n").alias("sd"),
        vec.sparse_compact("m").alias("sc"), vec.sparse_to_text("n").alias("st"), vec.sparse_add("m", "n").alias("sa"), vec.sparse_to_dense("n", 3).alias("dense"), F.round(vec.total(vec.softmax("a")), 9).alias("sm"), vec.outer("a", "a").alias("o"),
    ).first()
    assert r["l2"] == 5.0 and r["cos"] == 0.0 and r["nz"] == [0.0, 0.0] and r["am"] == 1 and (r["top"][0]["v"], r["top"][0]["i"]) == (4.0, 1) and r["eq"]
    assert r["sd"] == 6.0 and r["sc"] == {1: 2.0} and r["st"] == "1:3.0,2:1.0" and r["sa"] == {1: 5.0, 2: 1.0} and r["dense"] == [0.0, 3.0, 1.0] and r["sm"] == 1.0 and r["o"][1] == [12.0, 16.0]
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i int, j int, v double")
    assert {(x["i"], x["j"]): x["v"] for x in vec.matrix_multiply(m, m).collect()} == {(0, 0): 1.0, (0, 1): 8.0, (1, 1): 9.0}
    assert {x["i"]: x["v"] for x in vec.row_sums(vec.normalize_rows(m)).collect()} == {0: 1.0, 1: 1.0}
