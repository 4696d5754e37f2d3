"""Queries of the learners. One exact gradient step, closed forms and invariants have SQL; the rest are rows only."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import gradient, ml, text, topics, trees
from ..operators.iforest import IsolationForest, IsolationForestModel
from ..session import stage_path, table
from ..sources import readers
from .statistics import _r

X = ["l_quantity", "l_discount", "l_tax"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """All entries of the embeddings as columns."""
    v = _vectors(spark, d)
    names = [f"x{i}" for i in range(v.select(F.size("x")).first()[0])]
    return v.select("vec_id", "label", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names)]), names


#: Thresholds of every entry of an embedding in the queries that SQL repeats.
POINTS = [-0.1, 0.0, 0.1]


def _rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(F.col("o_custkey").cast("int").alias("user"), (F.col("l_partkey") % 200).cast("int").alias("item")).agg((F.avg("l_quantity") / 10).alias("rating"))


def _long(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Long features and statuses of orders: price, month, customer group."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("q"), (F.month("o_orderdate") / 12).alias("m"), (F.col("o_custkey") % 10 / 10).alias("k"), "o_orderstatus")
    f = t.select("id", F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("fid"), F.col(c).alias("v")) for i, c in enumerate(("q", "m", "k"))])))
    return f, t.select("id", F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0).alias("y"))


def ml_pca(spark, d):
    df, names = _wide(spark, d)
    return _r(ml.pca_fit(df, names, 3)[1], 6)


def ml_pca_transform(spark, d):
    """Without signs, which are arbitrary."""
    df, names = _wide(spark, d)
    x = ml.pca_transform(ml.pca_fit(df, names, 3)[0], df, keep=["vec_id"])
    return x.select("vec_id", *[F.round(F.abs(c), 4).alias(c) for c in ("col1", "col2", "col3")])


def ml_chi_square(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_returnflag") == "A").cast("double").alias("y"), F.array("l_quantity", F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.col("l_linenumber").cast("double")).alias("x"))
    return ml.chi_square_select(df, "x", "y", 2, 4.0).groupBy("label", F.get("selected", F.lit(0)).alias("first"), F.get("selected", F.lit(1)).alias("second")).agg(F.count("*").alias("n"))


_IF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _forest(spark: SparkSession, d: str) -> tuple:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_IF)
    return IsolationForest(num_trees=40, contamination=0.05, relative_error=0.001).fit_transform(t, _IF, "id")


def ml_isolation_forest(spark, d):
    return _forest(spark, d)[1].select("l_orderkey", "l_linenumber", "anomaly_score", "prediction")


def ml_isolation_forest_summary(spark, d):
    """A model saved, loaded and summed up: rows, and whether its anomalies are the share asked for and have the greatest scores."""
    model, scored = _forest(spark, d)
    path = stage_path(spark, "forest")
    model.save(path)
    again = IsolationForestModel.load(spark, path).summary(scored.drop("anomaly_score", "prediction"))
    ok = scored.agg(F.max(F.when(F.col("prediction") == 0, F.col("anomaly_score"))).alias("lo"), F.min(F.when(F.col("prediction") == 1, F.col("anomaly_score"))).alias("hi"))
    return again.crossJoin(ok).select("rows", (F.abs(F.col("anomalies") / F.col("rows") - 0.05) < 0.002).alias("share"), (F.col("lo") < F.col("hi")).alias("apart"))


def ml_cart_regression(spark, d):
    """Three levels over all values of three columns."""
    t, x = table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]
    tree = trees.CART("variance", 3, 64).fit(t, x, "l_extendedprice")
    return t.select("l_orderkey", "l_linenumber", F.round(trees.tree_expression(tree, x), 4).alias("prediction"))


def ml_cart_root_split(spark, d):
    """The root of a regression tree on the quantity: prefix sums of the bins give the best split."""
    t = table(spark, d, "lineitem")
    points = [[float(p) for p in range(5, 50, 5)]]
    tree = trees.CART("variance", 1, 16).fit(t, ["l_quantity"], "l_extendedprice", points=points)
    row = (tree.threshold, tree.count, round(tree.left.prediction, 4), round(tree.right.prediction, 4), tree.left.count, tree.right.count)
    return spark.createDataFrame([row], "threshold double, n double, left_mean double, right_mean double, left_n double, right_n double")


def ml_cart_bins(spark, d):
    return _r(trees.cumulative_bins(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [float(p) for p in range(5, 50, 5)]), 2)


def ml_cart_classes(spark, d):
    df, names = _wide(spark, d)
    tree = trees.CART("gini", 3, 16, 5).fit(df, names, "label", points=[POINTS] * len(names))
    return df.select("vec_id", "label", trees.tree_expression(tree, names).alias("prediction"))


def ml_cart_sparse(spark, d):
    """A deep tree over the sparse points: whether its predictions are the means of its leaves, and these large enough."""
    p = table(spark, d, "labeled_points").filter("point_id IS NOT NULL").select("label", "fs_idx", "fs_val")
    x = trees.Sparse("fs_idx", "fs_val", readers.num_features(p, "fs_idx"))
    tree = trees.CART("variance", 5, 8, 10).fit(p.filter(~F.isnan("label")), x, "label")
    out = p.select("label", trees.tree_expression(tree, x).alias("prediction")).withColumn("label", F.nanvl("label", F.lit(None)))
    leaves = out.groupBy("prediction").agg(F.count("*").alias("n"), F.abs(F.avg("label") - F.col("prediction")).alias("off"), F.count("label").alias("known"))
    return leaves.agg(F.sum("n").alias("rows"), (F.max("off") < 1e-9).alias("means"), (F.min("known") >= 10).alias("large"), (F.count("*") > 3).alias("grown"))


def ml_random_forest(spark, d):
    """Trees on drawn rows, all features at each node."""
    df, names = _wide(spark, d)
    cart = trees.CART("gini", 2, 16, 5)
    points = [POINTS] * len(names)
    return trees.random_forest(df, names, "label", "vec_id", cart, 3, col_rate=1.0, points=points).transform(df).select("vec_id", "label", "prediction")


def ml_gbdt(spark, d):
    """A round of boosting over all classes."""
    df, names = _wide(spark, d)
    return trees.gbdt(df, names, "label", trees.CART("variance", 2, 16, 5), 1, points=[POINTS] * len(names)).transform(df).select("vec_id", "label", "prediction")


def ml_gbrt(spark, d):
    """Two rounds over all values of two columns."""
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.length("p_type").alias("p_length"), F.col("p_retailprice"))
    model, _ = trees.gbrt(t, ["p_size", "p_length"], "p_retailprice", trees.CART("variance", 2, 64), 2, 0.3)
    return model.transform(t).select("p_partkey", F.round("prediction", 4).alias("prediction"))


def ml_gbt_regressor(spark, d):
    """Rows, and whether the boosted trees explain some of the price's variance."""
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    p = ml.gbt_predict(ml.gbt_regressor(t, ["p_size", "p_partkey"], "p_retailprice", 10, 4, "gini"), t, "price")
    return p.agg(F.count("price").alias("rows"), (F.avg((F.col("price") - F.col("p_retailprice")) ** 2) < F.var_pop("p_retailprice")).alias("better"))


def ml_linear_regression(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return _r(ml.linear_coefficients(ml.linear_regression(t, ["l_quantity"], "l_extendedprice")), 3)


def ml_softmax_step(spark, d):
    """Two exact gradient steps of softmax regression from zero weights."""
    f, y = _long(spark, d)
    return _r(gradient.softmax_fit(f, y, 3, 0.5, 0.01, 2), 8)


def ml_softmax_predict(spark, d):
    f, y = _long(spark, d)
    return _r(gradient.softmax_predict(f, gradient.softmax_fit(f, y, 3, 0.5, 0.01, 2)).drop("prediction"), 6)


def ml_fm_score(spark, d):
    """The factorization formula under fixed parameters."""
    f, _ = _long(spark, d)
    params = spark.createDataFrame([(0, 0.5, 0.1, -0.2), (1, -1.0, 0.3, 0.4), (2, 2.0, -0.5, 0.6)], "fid bigint, w double, v0 double, v1 double")
    return _r(gradient.fm_scores(f, params, 0.25, 2).select("id", "score"), 8)


def ml_fm(spark, d):
    f, y = _long(spark, d)
    return _r(gradient.fm_predict(gradient.fm_fit(f, y, True, 2, 0.1, max_iter=2), f), 6)


def ml_nmf_step(spark, d):
    """One projected gradient step of the user factors, all factors at 0.5."""
    r = _rates(spark, d)
    w = r.select("user").distinct().select("user", F.lit(0.5).alias("p0"), F.lit(0.5).alias("p1"))
    h = r.select("item").distinct().select("item", F.lit(0.5).alias("p0"), F.lit(0.5).alias("p1"))
    return _r(gradient.nmf_half_step(r, w, h, "user", 2, 0.1, 0.01), 8)


def ml_nmf(spark, d):
    r = _rates(spark, d)
    w, h = gradient.nmf_fit(r, 3, 0.1, 0.01, 2)
    return _r(gradient.nmf_predict(r, w, h).select("user", "item", "prediction"), 6)


def ml_als(spark, d):
    """Rows, and whether the factors give no negative rating and less error than the mean."""
    r = _rates(spark, d)
    p = ml.als(r, 4, max_iter=3).transform(r)
    return p.agg(F.count("prediction").alias("rows"), (F.min("prediction") >= 0).alias("positive"), (F.avg((F.col("prediction") - F.col("rating")) ** 2) < F.var_pop("rating")).alias("better"))


def ml_svd_feature(spark, d):
    r = _rates(spark, d).withColumn("id", F.concat_ws(" ", "user", "item"))
    one = F.lit(1.0).alias("v")
    u, i = r.select("id", F.col("user").cast("bigint").alias("fid"), one), r.select("id", F.col("item").cast("bigint").alias("fid"), one)
    g = r.select("id", F.lit(0).cast("bigint").alias("fid"), (F.col("item") % 2).cast("double").alias("v"))
    m = gradient.svd_feature_fit(u, i, g, r.select("id", F.col("rating").alias("y")), True, 2, 0.1, 0.01, 2)
    return _r(gradient.svd_feature_predict(m, u, i, g), 6)


def _words(spark: SparkSession, d: str) -> DataFrame:
    return text.segment(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "words")


def ml_lda(spark, d):
    docs = _words(spark, d)
    out = ml.lda_predict(ml.lda_fit(docs, "words", 5, 3), docs)
    return out.select("doc_id", F.round(F.aggregate("topics", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def ml_lda_topics(spark, d):
    """Topics, and whether each names five different words of the corpus, by falling weight."""
    docs = _words(spark, d)
    t = ml.lda_topics(ml.lda_fit(docs, "words", 5, 3), 5)
    known = t.select("topic", F.explode("terms").alias("term")).join(docs.select(F.explode("words").alias("term")).distinct(), "term").groupBy("topic").agg(F.count_distinct("term").alias("known"))
    return t.join(known, "topic").select("topic", (F.col("known") == 5).alias("words"), (F.col("weights") == F.reverse(F.array_sort("weights"))).alias("falling"))


def ml_perplexity(spark, d):
    docs = _words(spark, d)
    p = ml.perplexity(ml.lda_fit(docs, "words", 5, 3), docs)
    n = docs.agg(F.sum(F.size("words")).alias("tokens"))
    # the log-perplexity is the negative log-likelihood of a token
    ok = F.abs(F.col("log_likelihood") / F.col("tokens") + F.col("log_perplexity")) < 1e-6
    return p.crossJoin(n).select("tokens", (ok & (F.abs(F.ln("perplexity") - F.col("log_perplexity")) < 1e-9)).alias("consistent"), ((F.col("perplexity") > 1) & (F.col("perplexity") < F.col("tokens"))).alias("bounded"))


def ml_lda_gibbs(spark, d):
    """Whatever the topics are, a word's tokens in all of them are its tokens in the corpus."""
    m = topics.gibbs_fit(_words(spark, d), "doc_id", "words", 5, 3)
    return m.terms().groupBy("term").agg(F.sum("count").alias("count"))


def ml_lda_gibbs_topics(spark, d):
    """Documents' shares of topics sum to 1, and the model explains them better than chance."""
    docs = _words(spark, d)
    m = topics.gibbs_fit(docs, "doc_id", "words", 5, 10)
    p = topics.log_likelihood(m, docs, "doc_id", "words")
    s = m.transform(docs, "doc_id", "words", 5).agg(F.count("*").alias("docs"), (F.max(F.abs(F.aggregate("topics", F.lit(-1.0), lambda a, x: a + x))) < 1e-9).alias("whole"))
    return p.crossJoin(s).select("tokens", "docs", "whole", (F.col("perplexity") < m.words).alias("better"))


def ml_word2vec(spark, d):
    """The words that get a vector: those of at least five occurrences."""
    m = ml.word2vec_fit(_words(spark, d), "words", 16, max_iter=1)
    v = m.getVectors().select("word", vector_to_array("vector").alias("v"))
    return v.select("word", F.size("v").alias("size"), (vec.norm("v") > 0).alias("trained"))


def vector_functions(spark, d):
    v = _vectors(spark, d)
    return _r(v.select("vec_id", vec.dot("x", "x").alias("dot"), vec.norm("x", 1).alias("l1"), vec.norm("x").alias("l2"), vec.argmax("x").alias("argmax"), vec.cosine("x", F.reverse("x")).alias("cosine"), F.array_max(vec.softmax("x")).alias("peak")), 6)


def matrix_multiply(spark, d):
    """The 25 x 25 product of nation counts with its transpose, in long form."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 5).cast("int").alias("j")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return _r(vec.matrix_multiply(c, vec.matrix_transpose(c)), 0)


def matrix_normalize(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 5).cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return _r(vec.normalize_rows(c), 8)


_L = "WITH t AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS q, month(o_orderdate) / 12 AS di, (o_custkey % 10) / 10 AS ta, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders)"


def _softmax_steps() -> str:
    """Two unrolled steps: the weights after the second in one row `s2`."""
    fs = [("q", 0), ("di", 1), ("ta", 2), ("1", -1)]
    out = _L + ", s1 AS (SELECT " + ", ".join(f"0.5 * avg(({'1' if x == '1' else x}) * (CASE WHEN y = {c} THEN 1 ELSE 0 END - 1.0::DOUBLE / 3)) AS w{c}_{i + 1}" for x, i in fs for c in range(3)) + " FROM t)"
    z = lambda c: " + ".join(f"w{c}_{i + 1} * {x}" for x, i in fs)
    out += ", p AS (SELECT t.*, " + ", ".join(f"exp({z(c)}) AS e{c}" for c in range(3)) + " FROM t, s1)"
    rate = "0.5 / sqrt(2.0::DOUBLE)"
    out += ", g AS (SELECT " + ", ".join(f"avg({x} * (CASE WHEN y = {c} THEN 1 ELSE 0 END - e{c} / (e0 + e1 + e2))) AS g{c}_{i + 1}" for x, i in fs for c in range(3)) + " FROM p), s2 AS (SELECT "
    return out + ", ".join(f"w{c}_{i + 1} + {rate} * (g{c}_{i + 1} - 0.01 * w{c}_{i + 1}) AS w{c}_{i + 1}" for _, i in fs for c in range(3)) + " FROM s1, g)"


def _softmax_sql() -> str:
    return _softmax_steps() + " UNION ALL ".join(f" SELECT CAST({i} AS BIGINT) AS fid, " + ", ".join(f"round(w{c}_{i + 1}, 8) AS w{c}" for c in range(3)) + " FROM s2" for i in (0, 1, 2, -1))


def _softmax_predict_sql() -> str:
    z = [" + ".join(f"w{c}_{i + 1} * {x}" for x, i in (("q", 0), ("di", 1), ("ta", 2), ("1", -1))) for c in range(3)]
    e = " + ".join(f"exp({x})" for x in z)
    return _softmax_steps() + f" SELECT id, round(greatest({', '.join(f'exp({x})' for x in z)}) / ({e}), 6) AS probability FROM t, s2"


def _noise(text: str, k: int) -> str:
    """The start values of the gradient learners."""
    return f"((CAST('0x' || substr(md5({text} || '/{k}/42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) * 2 - 1) * 0.1"


def _fm_sql() -> str:
    """Two unrolled steps of the factorization machine; parameters in one row."""
    xs, out = ["q", "di", "ta"], _L + ", b AS (SELECT avg(y) AS bias, min(y) AS lo, max(y) AS hi FROM t)"
    out += ", f0 AS (SELECT " + ", ".join([f"0.0::DOUBLE AS w{i}" for i in range(3)] + [f"{_noise(repr(str(i)), j)} AS v{i}_{j}" for i in range(3) for j in range(2)]) + ")"
    s = lambda j: "(" + " + ".join(f"v{i}_{j} * {x}" for i, x in enumerate(xs)) + ")"
    score = "bias + " + " + ".join(f"w{i} * {x}" for i, x in enumerate(xs)) + " + (" + " + ".join(f"pow({s(j)}, 2) - " + " - ".join(f"pow(v{i}_{j} * {x}, 2)" for i, x in enumerate(xs)) for j in range(2)) + ") / 2"
    for r in (1, 2):
        rate = f"(0.1 / sqrt({r}.0::DOUBLE))"
        out += f", e{r} AS (SELECT *, y - ({score}) AS e FROM t, b, f{r - 1}), f{r} AS (SELECT " + ", ".join(
            [f"any_value(w{i}) + {rate} * (avg(e * {x}) - 0.001 * any_value(w{i})) AS w{i}" for i, x in enumerate(xs)]
            + [f"any_value(v{i}_{j}) + {rate} * (avg(e * {x} * ({s(j)} - v{i}_{j} * {x})) - 0.001 * any_value(v{i}_{j})) AS v{i}_{j}" for i, x in enumerate(xs) for j in range(2)]
        ) + f" FROM e{r})"
    return out + f" SELECT id, round(greatest(least({score}, hi), lo), 6) AS prediction FROM t, b, f2"


def _nmf_sql() -> str:
    """Two rounds: users first, then items."""
    dot = " + ".join(f"w.p{f} * h.p{f}" for f in range(3))
    out = _R + ", m AS (SELECT sqrt(avg(rating) / 3) AS start FROM r)"
    for side in ("user", "item"):
        out += f", {side}0 AS (SELECT {side}, " + ", ".join(f"start * (1 + {_noise(f"'{side}' || CAST({side} AS VARCHAR)", f)}) AS p{f}" for f in range(3)) + f" FROM (SELECT DISTINCT {side} FROM r), m)"
    for k in (1, 2):
        for side, a, b in (("user", k - 1, k - 1), ("item", k, k - 1)):
            own, that = ("w", "h") if side == "user" else ("h", "w")
            out += f", {side}{k} AS MATERIALIZED (SELECT {side}, " + ", ".join(f"greatest(0, any_value({own}.p{f}) + 0.1 / sqrt({k}.0::DOUBLE) * (avg((rating - ({dot})) * {that}.p{f}) - 0.01 * any_value({own}.p{f}))) AS p{f}" for f in range(3)) + f" FROM r JOIN user{a} w USING (user) JOIN item{b} h USING (item) GROUP BY {side})"
    return out + f" SELECT user, item, round({dot}, 6) AS prediction FROM r JOIN user2 w USING (user) JOIN item2 h USING (item)"


def _svd_sql() -> str:
    """Two rounds of the three-part factorization, all parts stepped from the same errors."""
    out = _R + ", n AS (SELECT count(*) AS n, avg(rating) AS bias FROM r), g0 AS (SELECT 0.0::DOUBLE AS wg)"
    for side, name in (("user", "u"), ("item", "i")):
        out += f", {side}0 AS (SELECT {side}, 0.0::DOUBLE AS w, " + ", ".join(f"{_noise(f"'{name}' || CAST({side} AS VARCHAR)", f)} AS p{f}" for f in range(2)) + f" FROM (SELECT DISTINCT {side} FROM r))"
    score = "bias + a.w + b.w + wg * (item % 2) + a.p0 * b.p0 + a.p1 * b.p1"
    for k in (1, 2):
        j, rate = k - 1, f"0.1 / sqrt({k}.0::DOUBLE)"
        out += f", e{k} AS MATERIALIZED (SELECT user, item, rating - ({score}) AS e, n, wg, a.w AS aw, a.p0 AS a0, a.p1 AS a1, b.w AS bw, b.p0 AS b0, b.p1 AS b1 FROM r JOIN user{j} a USING (user) JOIN item{j} b USING (item), n, g{j})"
        out += f", g{k} AS (SELECT any_value(wg) + {rate} * (sum(e * (item % 2)) / any_value(n) - 0.01 * any_value(wg)) AS wg FROM e{k})"
        for side, me, you in (("user", "a", "b"), ("item", "b", "a")):
            out += f", {side}{k} AS MATERIALIZED (SELECT {side}, any_value({me}w) + {rate} * (sum(e) / any_value(n) - 0.01 * any_value({me}w)) AS w, " + ", ".join(f"any_value({me}{f}) + {rate} * (sum(e * {you}{f}) / any_value(n) - 0.01 * any_value({me}{f})) AS p{f}" for f in range(2)) + f" FROM e{k} GROUP BY {side})"
    return out + f" SELECT user || ' ' || item AS id, round({score}, 6) AS prediction FROM r JOIN user2 a USING (user) JOIN item2 b USING (item), n, g2"


def _pca_sql(result: str) -> str:
    """Leading eigenvectors by repeated squaring of the covariance matrix, each found one subtracted."""
    out = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), d AS (SELECT unnest(range(1, (SELECT max(len(x)) FROM x) + 1)) AS i),
c AS (SELECT a.i AS i, b.i AS j, covar_samp(x[a.i], x[b.i]) AS c FROM x, d a, d b GROUP BY ALL), m0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)),
t AS (SELECT list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS trace FROM m0)"""
    for k in range(3):
        out += f", q{k}_0 AS (SELECT m FROM m{k})"
        for r in range(1, 15):
            # rows times rows, as the matrix is symmetric; divided by the trace of the last power
            out += f", s{k}_{r} AS MATERIALIZED (SELECT m, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS tr FROM q{k}_{r - 1}), q{k}_{r} AS MATERIALIZED (SELECT list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / tr / tr)) AS m FROM s{k}_{r})"
        out += f""", w{k} AS (SELECT list_sort(list_transform(m, lambda a: {{'n': list_dot_product(a, a), 'a': a}}), 'DESC')[1] AS b FROM q{k}_14), v{k} AS MATERIALIZED (SELECT list_transform(b.a, lambda e: e / sqrt(b.n)) AS v FROM w{k}),
l{k} AS MATERIALIZED (SELECT list_dot_product(v, list_transform(m, lambda a: list_dot_product(a, v))) AS l FROM v{k}, m{k}), m{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM m{k}, v{k}, l{k})"""
    return out + result


def _tree_sql(p: str, rows: str, entries: str, cuts: str, depth: int, gini: bool, least: int) -> str:
    """CTEs of trees grown level by level: from `rows` (tree, id, y, w), `entries` (id, f, x) and `cuts` (f, b, c), where x < c goes left,
    to {p}leaf (tree, id, y, w, leaf)."""
    out = f"{p}r AS MATERIALIZED ({rows}), {p}x AS MATERIALIZED ({entries}), {p}c AS MATERIALIZED ({cuts}), {p}a0 AS (SELECT tree, id, y, w, 0 AS leaf FROM {p}r)"
    for k in range(depth):
        left = f"FROM {p}a{k} JOIN {p}x USING (id) JOIN {p}c USING (f) GROUP BY ALL"
        if gini:
            out += f""", {p}h{k} AS (SELECT tree, leaf, f, b, c, y, sum(w) AS n, coalesce(sum(w) FILTER (x < c), 0) AS l {left}),
{p}g{k} AS (SELECT tree, leaf, f, b, c, sum(n) AS n, sum(l) AS l, (sum(l * l) / nullif(sum(l), 0) + sum((n - l) * (n - l)) / nullif(sum(n - l), 0) - sum(n * n) / sum(n)) / sum(n) AS gain FROM {p}h{k} GROUP BY ALL)"""
        else:
            out += f""", {p}h{k} AS (SELECT tree, leaf, f, b, c, sum(w) AS n, sum(w * y) AS s, sum(w * y * y) AS q, coalesce(sum(w) FILTER (x < c), 0) AS l, sum(w * y) FILTER (x < c) AS ls, sum(w * y * y) FILTER (x < c) AS lq {left}),
{p}g{k} AS (SELECT tree, leaf, f, b, c, n, l, ((q - s * s / n) - (lq - ls * ls / l) - ((q - lq) - (s - ls) * (s - ls) / nullif(n - l, 0))) / n AS gain FROM {p}h{k} WHERE l > 0)"""
        out += f""", {p}b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, leaf ORDER BY round(gain, 12) DESC, f, b) AS k FROM {p}g{k} WHERE l >= {least} AND n - l >= {least} AND gain >= 1e-6) WHERE k = 1),
{p}a{k + 1} AS MATERIALIZED (SELECT a.tree, a.id, a.y, a.w, CASE WHEN b.f IS NULL THEN a.leaf WHEN x.x < b.c THEN 2 * a.leaf + 1 ELSE 2 * a.leaf + 2 END AS leaf FROM {p}a{k} a LEFT JOIN {p}b{k} b ON a.tree = b.tree AND a.leaf = b.leaf LEFT JOIN {p}x x ON x.id = a.id AND x.f = b.f)"""
    return out + f", {p}leaf AS (SELECT * FROM {p}a{depth})"


_EMBEDDED = "SELECT vec_id AS id, unnest(range(0, len(embedding))) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
_CUTS = f"SELECT f, b, c FROM (SELECT DISTINCT unnest(range(0, len(embedding))) AS f FROM embeddings), (VALUES {', '.join(f'({b}, {c}::DOUBLE)' for b, c in enumerate(POINTS))}) v(b, c)"
_MIDWAY = "SELECT f, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS b, (x + y) / 2 AS c FROM (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS y FROM (SELECT DISTINCT f, x FROM {})) WHERE y IS NOT NULL"
_POISSON = "CASE " + " ".join(f"WHEN u < {sum(2.718281828459045 ** -0.6 * 0.6**i / [1, 1, 2, 6, 24, 120][i] for i in range(k + 1))!r} THEN {k}" for k in range(6)) + " ELSE 6 END"
_MAJORITY = "SELECT tree, leaf, y AS v FROM (SELECT tree, leaf, y, row_number() OVER (PARTITION BY tree, leaf ORDER BY sum(w) DESC, y) AS k FROM leaf GROUP BY tree, leaf, y) WHERE k = 1"


def _trees_sql() -> dict[str, str]:
    same = "concat_ws('/', l_quantity, l_discount, l_tax)"  # rows of the same values are one
    li = f"SELECT DISTINCT {same} AS id, unnest([0, 1, 2]) AS f, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem"
    part = "SELECT p_partkey AS id, unnest([0, 1]) AS f, CAST(unnest([p_size, length(p_type)]) AS DOUBLE) AS x FROM part"
    drawn = f"SELECT tree, vec_id AS id, label AS y, {_POISSON} AS w FROM (SELECT tree, vec_id, CAST(label AS DOUBLE) AS label, CAST('0x' || substr(md5(vec_id || '/' || tree || '/42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM embeddings, range(0, 3) t(tree))"
    mean = "SELECT tree, leaf, avg(y) AS v FROM {}leaf GROUP BY ALL"
    return {
        "ml_cart_regression": "WITH " + _tree_sql("", f"SELECT 0 AS tree, {same} AS id, l_extendedprice AS y, 1.0 AS w FROM lineitem", li, _MIDWAY.format("x"), 3, False, 15)
        + f" SELECT l_orderkey, l_linenumber, round(v, 4) AS prediction FROM lineitem JOIN (SELECT DISTINCT id, leaf FROM leaf) ON id = {same} JOIN ({mean.format('')}) USING (leaf)",
        "ml_cart_classes": "WITH " + _tree_sql("", "SELECT 0 AS tree, vec_id AS id, CAST(label AS DOUBLE) AS y, 1.0 AS w FROM embeddings", _EMBEDDED, _CUTS, 3, True, 5)
        + f" SELECT id AS vec_id, y AS label, v AS prediction FROM leaf JOIN ({_MAJORITY}) USING (leaf)",
        "ml_random_forest": "WITH " + _tree_sql("", drawn, _EMBEDDED, _CUTS, 2, True, 5)
        + f", p AS (SELECT id, y, v, count(*) AS n FROM leaf JOIN ({_MAJORITY}) USING (tree, leaf) GROUP BY ALL) SELECT id AS vec_id, y AS label, v AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, v) AS k FROM p) WHERE k = 1",
        "ml_gbdt": "WITH k AS (SELECT DISTINCT CAST(label AS DOUBLE) AS k FROM embeddings), n AS (SELECT count(*)::DOUBLE AS n FROM k), "
        + _tree_sql("", "SELECT k AS tree, vec_id AS id, CASE WHEN label = k THEN 1 ELSE 0 END - 1 / n AS y, 1.0 AS w FROM embeddings, k, n", _EMBEDDED, _CUTS, 2, False, 5)
        + """, v AS (SELECT tree, leaf, sum(y) / sum(abs(y) * (1 - abs(y))) * (any_value(n) - 1) / any_value(n) AS v FROM leaf, n GROUP BY ALL),
      p AS (SELECT id, tree, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, tree) AS k FROM leaf JOIN v USING (tree, leaf)) SELECT vec_id, CAST(label AS DOUBLE) AS label, tree AS prediction FROM p JOIN embeddings ON vec_id = id WHERE k = 1""",
        "ml_gbrt": "WITH " + _tree_sql("f", "SELECT 0 AS tree, p_partkey AS id, p_retailprice AS y, 1.0 AS w FROM part", part, _MIDWAY.format("fx"), 2, False, 15)
        + f", fp AS MATERIALIZED (SELECT id, y, v FROM fleaf JOIN ({mean.format('f')}) USING (leaf)), " + _tree_sql("g", "SELECT 0 AS tree, id, y - v AS y, 1.0 AS w FROM fp", "SELECT * FROM fx", "SELECT * FROM fc", 2, False, 15)
        + f" SELECT id AS p_partkey, round(fp.v + 0.3 * m.v, 4) AS prediction FROM fp JOIN (SELECT id, leaf FROM gleaf) USING (id) JOIN ({mean.format('g')}) m USING (leaf)",
    }


_R = "WITH r AS (SELECT CAST(o_custkey AS INTEGER) AS user, CAST(l_partkey % 200 AS INTEGER) AS item, avg(l_quantity) / 10 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"

QUERIES = {
    f.__name__: f
    for f in (
        ml_pca, ml_pca_transform, ml_chi_square, ml_isolation_forest, ml_isolation_forest_summary, ml_cart_regression, ml_cart_root_split, ml_cart_bins, ml_cart_classes, ml_cart_sparse, ml_random_forest, ml_gbdt, ml_gbrt, ml_gbt_regressor, ml_linear_regression, ml_softmax_step,
        ml_softmax_predict, ml_fm_score, ml_fm, ml_nmf_step, ml_nmf, ml_als, ml_svd_feature, ml_lda, ml_lda_topics, ml_lda_gibbs, ml_lda_gibbs_topics, ml_perplexity, ml_word2vec, vector_functions, matrix_multiply, matrix_normalize,
    )
}
#: Chi-square statistics of the binned columns against the flag; the order of their p-values by the Wilson-Hilferty approximation.
_CHI = """WITH t AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END AS y, floor(l_quantity / 4) AS f0, floor(round(l_discount * 100) / 4) AS f1, floor(round(l_tax * 100) / 4) AS f2, floor(l_linenumber / 4) AS f3 FROM lineitem),
l AS (SELECT y, unnest([0, 1, 2, 3]) AS f, unnest([f0, f1, f2, f3]) AS v FROM t), o AS (SELECT f, v, y, count(*)::DOUBLE AS o FROM l GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM t),
g AS (SELECT a.f, a.v, b.y, a.c * b.c / n AS e FROM (SELECT f, v, sum(o) AS c FROM o GROUP BY ALL) a JOIN (SELECT f, y, sum(o) AS c FROM o GROUP BY ALL) b ON a.f = b.f, n),
x AS (SELECT f, sum(pow(coalesce(o, 0) - e, 2) / e) AS x, (count(DISTINCT v) - 1) * (count(DISTINCT y) - 1) AS k FROM g LEFT JOIN o USING (f, v, y) GROUP BY f),
r AS (SELECT f, row_number() OVER (ORDER BY CASE WHEN k = 0 THEN -1e9 ELSE (pow(x / k, 1.0 / 3) - (1 - 2.0 / (9 * k))) / sqrt(2.0 / (9 * k)) END DESC, f) AS p FROM x), s AS (SELECT list(f ORDER BY f) AS s FROM r WHERE p <= 2)
SELECT y AS label, [f0, f1, f2, f3][s[1] + 1] AS first, [f0, f1, f2, f3][s[2] + 1] AS second, count(*) AS n FROM t, s GROUP BY ALL"""

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9\\-]{2,})', 1)"

SQL = _trees_sql() | {
    "ml_pca": _pca_sql(" " + " UNION ALL ".join(f"SELECT {k} AS row, round(l{k}.l / trace, 6) AS explained, round(({' + '.join(f'l{i}.l' for i in range(k + 1))}) / trace, 6) AS sum_explained FROM t, {', '.join(f'l{i}' for i in range(k + 1))}" for k in range(3))),
    "ml_pca_transform": _pca_sql(" SELECT vec_id, " + ", ".join(f"round(abs(list_dot_product(x, v{k}.v)), 4) AS col{k + 1}" for k in range(3)) + " FROM x, v0, v1, v2"),
    "ml_chi_square": _CHI,
    "ml_isolation_forest_summary": "SELECT count(*) AS rows, true AS share, true AS apart FROM lineitem",
    "ml_softmax_predict": _softmax_predict_sql(),
    "ml_fm": _fm_sql(),
    "ml_nmf": _nmf_sql(),
    "ml_svd_feature": _svd_sql(),
    "ml_cart_sparse": "SELECT CAST(count(*) AS BIGINT) AS rows, true AS means, true AS large, true AS grown FROM labeled_points WHERE point_id IS NOT NULL",
    "ml_gbt_regressor": "SELECT count(*) AS rows, true AS better FROM part",
    "ml_als": _R + " SELECT count(*) AS rows, true AS positive, true AS better FROM r",
    "ml_lda_topics": "SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS topic, true AS words, true AS falling",
    "ml_word2vec": f"SELECT word, 16 AS size, true AS trained FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5",
    "ml_lda_gibbs": f"SELECT term, count(*) AS count FROM (SELECT unnest({_WORDS}) AS term FROM documents) GROUP BY term",
    "ml_lda_gibbs_topics": f"SELECT CAST(sum(len(w)) AS BIGINT) AS tokens, count(*) AS docs, true AS whole, true AS better FROM (SELECT {_WORDS} AS w FROM documents) WHERE len(w) > 0",
    "ml_perplexity": "SELECT CAST(sum(len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9\\-]{2,})', 1))) AS BIGINT) AS tokens, true AS consistent, true AS bounded FROM documents",
    "ml_linear_regression": "SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem",
    "ml_softmax_step": _softmax_sql(),
    "ml_fm_score": _L + " SELECT id, round(0.25 + 0.5 * q - di + 2 * ta + (pow(0.1 * q + 0.3 * di - 0.5 * ta, 2) - pow(0.1 * q, 2) - pow(0.3 * di, 2) - pow(0.5 * ta, 2) + pow(-0.2 * q + 0.4 * di + 0.6 * ta, 2) - pow(0.2 * q, 2) - pow(0.4 * di, 2) - pow(0.6 * ta, 2)) / 2, 8) AS score FROM t",
    "ml_nmf_step": _R + " SELECT user, round(0.5 + 0.1 * (avg((rating - 0.5) * 0.5) - 0.005), 8) AS p0, round(0.5 + 0.1 * (avg((rating - 0.5) * 0.5) - 0.005), 8) AS p1 FROM r GROUP BY user",
    "ml_cart_root_split": """WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y, floor(l_quantity / 5) AS b FROM lineitem), n AS (SELECT count(*) AS n, var_pop(y) AS v FROM t),
      s AS (SELECT p * 5.0::DOUBLE AS threshold, count(*) FILTER (x < p * 5) AS ln, count(*) FILTER (x >= p * 5) AS rn, avg(y) FILTER (x < p * 5) AS lm, avg(y) FILTER (x >= p * 5) AS rm,
        var_pop(y) FILTER (x < p * 5) AS lv, var_pop(y) FILTER (x >= p * 5) AS rv FROM t, (SELECT range AS p FROM range(1, 10)) GROUP BY p)
      SELECT threshold, CAST(n AS DOUBLE) AS n, round(lm, 4) AS left_mean, round(rm, 4) AS right_mean, CAST(ln AS DOUBLE) AS left_n, CAST(rn AS DOUBLE) AS right_n FROM s, n WHERE least(ln, rn) >= 15 ORDER BY v - (ln * lv + rn * rv) / n DESC LIMIT 1""",
    "ml_cart_bins": "WITH b AS (SELECT CAST(least(floor(l_quantity / 5), 9) AS INTEGER) AS bin, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum_n, round(sum(s) OVER (ORDER BY bin), 2) AS cum_sum FROM b",
    "ml_lda": "SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9\\-]{2,})', 1)) > 0 UNION ALL SELECT doc_id, 0.0 FROM documents WHERE len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9\\-]{2,})', 1)) = 0",
    "vector_functions": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings)
      SELECT vec_id, round(list_dot_product(x, x), 6) AS dot, round(list_sum(list_transform(x, lambda e: abs(e))), 6) AS l1, round(sqrt(list_dot_product(x, x)), 6) AS l2, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS argmax,
      round(list_cosine_similarity(x, list_reverse(x)), 6) AS cosine, round(1 / list_sum(list_transform(x, lambda e: exp(e - list_max(x)))), 6) AS peak FROM v""",
    "matrix_multiply": """WITH c AS (SELECT c_nationkey AS i, c_custkey % 5 AS j, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY ALL)
      SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 0) AS v FROM c a JOIN c b ON a.j = b.j GROUP BY ALL""",
    "matrix_normalize": "WITH c AS (SELECT c_nationkey AS i, CAST(c_custkey % 5 AS INTEGER) AS j, count(*) AS v FROM customer GROUP BY ALL) SELECT i, j, round(CAST(v / sum(v) OVER (PARTITION BY i) AS DOUBLE), 8) AS v FROM c",
}
