"""Models trained by full-batch gradient steps, as joins and aggregates on long feature tables.

Rows are (id, fid, v) features and (id, y) labels. Parameters are tables keyed by feature id, so that neither
features nor parameters need to fit in a task or the driver; each step is two joins and two partial aggregations, and
lineage is cut after every step.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..session import cut, staged


def _add(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def sparse_to_long(df: DataFrame, key: str, idx: str, val: str) -> DataFrame:
    """(id, fid, v) of rows with a pair of sparse arrays; zeros dropped."""
    x = df.select(F.col(key).alias("id"), F.explode(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v"))).alias("e"))
    return x.select("id", F.col("e.i").cast("bigint").alias("fid"), F.col("e.v").cast("double").alias("v")).filter("v <> 0")


def _noise(fid: Column, k: int, seed: int, scale: float) -> Column:
    """A repeatable pseudo-random start value in [-scale, scale)."""
    return (uniform(F.concat_ws("/", fid.cast("string"), F.lit(str(k)), F.lit(str(seed)))) * 2 - 1) * scale


# --- softmax regression ---------------------------------------------------------------------------------------------
def softmax_start(features: DataFrame, classes: int, spread: float = 0.0, seed: int = 42) -> DataFrame:
    """(fid, w0, w1, ...) with the bias as feature -1: all zero, or drawn from [-spread, spread)."""
    ids = features.select("fid").distinct().union(features.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("fid")))
    return ids.select("fid", *[(_noise(F.col("fid"), c, seed, spread) if spread else F.lit(0.0)).alias(f"w{c}") for c in range(classes)])


def _with_bias(features: DataFrame) -> DataFrame:
    return features.union(features.select("id").distinct().select("id", F.lit(-1).cast("bigint").alias("fid"), F.lit(1.0).alias("v")))


def softmax_scores(features: DataFrame, params: DataFrame, classes: int) -> DataFrame:
    """(id, p0, p1, ...): class probabilities; `features` holds the bias feature."""
    z = features.join(params, "fid").groupBy("id").agg(*[F.sum(F.col("v") * F.col(f"w{c}")).alias(f"z{c}") for c in range(classes)])
    top = F.greatest(*[F.col(f"z{c}") for c in range(classes)]) if classes > 1 else F.col("z0")
    e = [F.exp(F.col(f"z{c}") - top) for c in range(classes)]
    return z.select("id", *[(e[c] / _add(e)).alias(f"p{c}") for c in range(classes)])


def softmax_step(features: DataFrame, labels: DataFrame, params: DataFrame, classes: int, n: int, rate: float, reg: float) -> DataFrame:
    """One step: w += rate * (mean of (y - p) x - reg * w), the bias regularised like the weights."""
    p = softmax_scores(features, params, classes).join(labels, "id")
    err = p.select("id", *[(F.when(F.col("y") == c, 1.0).otherwise(0.0) - F.col(f"p{c}")).alias(f"e{c}") for c in range(classes)])
    g = features.join(err, "id").groupBy("fid").agg(*[(F.sum(F.col("v") * F.col(f"e{c}")) / n).alias(f"g{c}") for c in range(classes)])
    return params.join(g, "fid", "left").select("fid", *[(F.col(f"w{c}") + rate * (F.coalesce(f"g{c}", F.lit(0.0)) - reg * F.col(f"w{c}"))).alias(f"w{c}") for c in range(classes)])


def softmax_fit(features: DataFrame, labels: DataFrame, classes: int, learn_rate: float = 0.01, reg: float = 0.01, max_iter: int = 10, spread: float = 0.0, summed: bool = False) -> DataFrame:
    """Multinomial logistic regression, learning rate / sqrt(round). Returns (fid, w0, ...), bias as -1.

    It starts from zero weights, or from draws of up to `spread`. Gradients are means over the rows, or with `summed` their sums, for which
    learning rates must shrink with the table.
    """
    f = staged(_with_bias(features), "features")
    n = max(labels.count(), 1)
    n = 1 if summed else n
    params = cut(softmax_start(features, classes, spread))
    for k in range(max_iter):
        params = cut(softmax_step(f, labels, params, classes, n, learn_rate / (k + 1) ** 0.5, reg))
    return params


def softmax_predict(features: DataFrame, params: DataFrame) -> DataFrame:
    """(id, prediction, probability): the likeliest class, ties to the lesser."""
    classes = len(params.columns) - 1
    p = softmax_scores(_with_bias(features), params, classes)
    best = F.array_max(F.array(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(-c).alias("c")) for c in range(classes)]))
    return p.select("id", (-best["c"]).cast("double").alias("prediction"), best["p"].alias("probability"))


# --- factorization machine --------------------------------------------------------------------------------------------
@dataclass
class FMModel:
    """y = bias + w x + (1/2) sum_f [(v_f x)^2 - (v_f^2 x^2)]; `params` is (fid, w, v0, v1, ...)."""

    params: DataFrame
    bias: float
    k: int
    regression: bool = True
    low: float = float("-inf")
    high: float = float("inf")


def fm_scores(features: DataFrame, params: DataFrame, bias: float, k: int) -> DataFrame:
    """(id, score, s0, s1, ...): raw scores and the factor sums. Unknown features take the mean parameters."""
    names = ["w", *[f"v{f}" for f in range(k)]]
    mean = params.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m_{c}") for c in names])  # one row
    x = features.join(params, "fid", "left").crossJoin(F.broadcast(mean))
    p = {c: F.coalesce(F.col(c), F.col(f"m_{c}")) for c in names}
    aggs = [F.sum(F.col("v") * p["w"]).alias("lin")]
    for f in range(k):
        t = F.col("v") * p[f"v{f}"]
        aggs += [F.sum(t).alias(f"s{f}"), F.sum(t * t).alias(f"q{f}")]
    pair = _add([F.col(f"s{f}") * F.col(f"s{f}") - F.col(f"q{f}") for f in range(k)]) / 2 if k else F.lit(0.0)
    return x.groupBy("id").agg(*aggs).select("id", (F.lit(bias) + F.col("lin") + pair).alias("score"), *[f"s{f}" for f in range(k)])


def fm_step(features: DataFrame, labels: DataFrame, params: DataFrame, bias: float, k: int, n: int, rate: float, reg_w: float, reg_v: float) -> DataFrame:
    """One gradient step on squared errors of all parameters but the bias."""
    s = fm_scores(features, params, bias, k).join(labels, "id").withColumn("e", F.col("y") - F.col("score")).drop("y", "score")
    x = features.join(params, "fid").join(s, "id")
    aggs = [(F.sum(F.col("e") * F.col("v")) / n).alias("gw")]
    aggs += [(F.sum(F.col("e") * F.col("v") * (F.col(f"s{f}") - F.col(f"v{f}") * F.col("v"))) / n).alias(f"g{f}") for f in range(k)]
    g = x.groupBy("fid").agg(*aggs)
    zero = F.lit(0.0)
    return params.join(g, "fid", "left").select(
        "fid", (F.col("w") + rate * (F.coalesce("gw", zero) - reg_w * F.col("w"))).alias("w"),
        *[(F.col(f"v{f}") + rate * (F.coalesce(f"g{f}", zero) - reg_v * F.col(f"v{f}"))).alias(f"v{f}") for f in range(k)],
    )


def fm_fit(features: DataFrame, labels: DataFrame, regression: bool = True, k: int = 8, learn_rate: float = 0.001, reg_w: float = 0.001, reg_v: float = 0.001, init: float = 0.1, max_iter: int = 50, seed: int = 42) -> FMModel:
    """Labels are numbers (regression) or 0/1 (classification, trained on -1/+1). The bias stays at the mean label."""
    y = labels if regression else labels.select("id", F.when(F.col("y") > 0.5, 1.0).otherwise(-1.0).alias("y"))
    n, bias, low, high = y.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
    f = staged(features, "features")
    params = cut(f.select("fid").distinct().select("fid", F.lit(0.0).alias("w"), *[_noise(F.col("fid"), j, seed, init).alias(f"v{j}") for j in range(k)]))
    for r in range(max_iter):
        params = cut(fm_step(f, y, params, bias or 0.0, k, max(n, 1), learn_rate / (r + 1) ** 0.5, reg_w, reg_v))
    return FMModel(params, bias or 0.0, k, regression, low if n else 0.0, high if n else 0.0)


def fm_predict(model: FMModel, features: DataFrame) -> DataFrame:
    """(id, prediction): clipped to the training labels' range (regression), or 1.0 / 0.0."""
    s = fm_scores(features, model.params, model.bias, model.k)
    p = F.greatest(F.least(F.col("score"), F.lit(model.high)), F.lit(model.low)) if model.regression else F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    return s.select("id", p.alias("prediction"))


# --- non-negative factorization -----------------------------------------------------------------------------------------
def _dot(k: int, a: str = "p", b: str = "q") -> Column:
    return _add([F.col(f"{a}{f}") * F.col(f"{b}{f}") for f in range(k)])


def nmf_half_step(rates: DataFrame, own: DataFrame, other: DataFrame, side: str, k: int, rate: float, reg: float) -> DataFrame:
    """Projected gradient step of one side's factors (side, p0, ...), the other's (q0, ...) fixed: a mean over the side's ratings."""
    that = "item" if side == "user" else "user"
    x = rates.join(own, side).join(other.select(that, *[F.col(f"p{f}").alias(f"q{f}") for f in range(k)]), that)
    e = F.col("rating") - _dot(k)
    g = x.groupBy(side).agg(*[F.avg(e * F.col(f"q{f}")).alias(f"g{f}") for f in range(k)])
    return own.join(g, side, "left").select(side, *[F.greatest(F.col(f"p{f}") + rate * (F.coalesce(f"g{f}", F.lit(0.0)) - reg * F.col(f"p{f}")), F.lit(0.0)).alias(f"p{f}") for f in range(k)])


def nmf_fit(rates: DataFrame, k: int = 10, learn_rate: float = 0.01, reg: float = 0.01, max_iter: int = 100, decay: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Factors (user, p0, ...) and (item, p0, ...) >= 0 of (user, item, rating): users first, then items, each round.

    Starts at sqrt(mean / k) with a seeded jitter per id and component, so that components differ.
    """
    rates = staged(rates.select("user", "item", F.col("rating").cast("double").alias("rating")).filter("rating IS NOT NULL"), "rates")
    mean = rates.agg(F.avg("rating")).first()[0] or 0.0
    start = (max(mean, 0.0) / k) ** 0.5

    def factors(side: str) -> DataFrame:
        return cut(rates.select(side).distinct().select(side, *[(F.lit(start) * (1 + _noise(F.concat(F.lit(side), F.col(side).cast("string")), f, seed, 0.1))).alias(f"p{f}") for f in range(k)]))

    w, h = factors("user"), factors("item")
    for r in range(max_iter):
        lr = learn_rate / (r + 1) ** 0.5 if decay else learn_rate
        w = cut(nmf_half_step(rates, w, h, "user", k, lr, reg))
        h = cut(nmf_half_step(rates, h, w, "item", k, lr, reg))
    return w, h


def nmf_predict(pairs: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """`pairs` (user, item, ...) with `prediction`; an unknown user or item takes the mean factors."""
    k = len(w.columns) - 1
    mw = w.agg(*[F.avg(f"p{f}").alias(f"mp{f}") for f in range(k)])
    mh = h.agg(*[F.avg(f"p{f}").alias(f"mq{f}") for f in range(k)])
    x = pairs.join(w, "user", "left").join(h.select("item", *[F.col(f"p{f}").alias(f"q{f}") for f in range(k)]), "item", "left").crossJoin(F.broadcast(mw)).crossJoin(F.broadcast(mh))
    y = _add([F.coalesce(f"p{f}", f"mp{f}") * F.coalesce(f"q{f}", f"mq{f}") for f in range(k)])
    return x.withColumn("prediction", y).select(*pairs.columns, "prediction")


# --- three-part features ------------------------------------------------------------------------------------------------
def svd_scores(u: DataFrame, i: DataFrame, g: DataFrame, pu: DataFrame, pi: DataFrame, pg: DataFrame, bias: float, k: int) -> DataFrame:
    """(id, score, a0.., b0..): bias + wu xu + wi xi + wg xg + (U xu) . (I xi), and both sides' factor sums."""

    def side(x: DataFrame, p: DataFrame, name: str) -> DataFrame:
        return x.join(p, "fid").groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias(f"l{name}"), *[F.sum(F.col("v") * F.col(f"p{f}")).alias(f"{name}{f}") for f in range(k)])

    ids = u.select("id").union(i.select("id")).union(g.select("id")).distinct()
    x = ids.join(side(u, pu, "a"), "id", "left").join(side(i, pi, "b"), "id", "left").join(g.join(pg, "fid").groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("lg")), "id", "left")
    x = x.na.fill(0.0)
    return x.select("id", (F.lit(bias) + F.col("la") + F.col("lb") + F.col("lg") + _dot(k, "a", "b")).alias("score"), *[f"a{f}" for f in range(k)], *[f"b{f}" for f in range(k)])


@dataclass
class SVDFeatureModel:
    users: DataFrame
    items: DataFrame
    globals: DataFrame
    bias: float
    k: int
    regression: bool


def svd_feature_fit(u: DataFrame, i: DataFrame, g: DataFrame, labels: DataFrame, regression: bool = True, k: int = 10, learn_rate: float = 0.01, reg: float = 0.1, max_iter: int = 10, seed: int = 42) -> SVDFeatureModel:
    """Three-part factorization on long features of users, items and globals; steps on mean errors, rate / sqrt(round)."""
    y = labels if regression else labels.select("id", F.when(F.col("y") > 0.5, 1.0).otherwise(-1.0).alias("y"))
    n, bias = y.agg(F.count("*"), F.avg("y")).first()
    n, bias = max(n, 1), bias or 0.0
    u, i, g = staged(u, "u"), staged(i, "i"), staged(g, "g")

    def start(x: DataFrame, name: str, factors: bool) -> DataFrame:
        cols = [_noise(F.concat(F.lit(name), F.col("fid").cast("string")), f, seed, 0.1).alias(f"p{f}") for f in range(k)] if factors else []
        return cut(x.select("fid").distinct().select("fid", F.lit(0.0).alias("w"), *cols))

    pu, pi, pg = start(u, "u", True), start(i, "i", True), start(g, "g", False)
    for r in range(max_iter):
        rate = learn_rate / (r + 1) ** 0.5
        s = cut(svd_scores(u, i, g, pu, pi, pg, bias, k).join(y, "id").withColumn("e", F.col("y") - F.col("score")).drop("y", "score"))

        def step(x: DataFrame, p: DataFrame, other: str | None) -> DataFrame:
            j = x.join(s, "id")
            aggs = [(F.sum(F.col("e") * F.col("v")) / n).alias("gw")]
            if other:
                aggs += [(F.sum(F.col("e") * F.col("v") * F.col(f"{other}{f}")) / n).alias(f"g{f}") for f in range(k)]
            grad = j.groupBy("fid").agg(*aggs)
            cols = [(F.col(c) + rate * (F.coalesce(d, F.lit(0.0)) - reg * F.col(c))).alias(c) for c, d in [("w", "gw"), *([(f"p{f}", f"g{f}") for f in range(k)] if other else [])]]
            return cut(p.join(grad, "fid", "left").select("fid", *cols))

        pg, pu, pi = step(g, pg, None), step(u, pu, "b"), step(i, pi, "a")
    return SVDFeatureModel(pu, pi, pg, bias, k, regression)


def svd_feature_predict(model: SVDFeatureModel, u: DataFrame, i: DataFrame, g: DataFrame) -> DataFrame:
    """(id, prediction): the score, or its sign as 1.0 / 0.0 for classification."""
    s = svd_scores(u, i, g, model.users, model.items, model.globals, model.bias, model.k)
    return s.select("id", (F.col("score") if model.regression else F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("prediction"))
