"""Decision trees on binned features: level-wise histograms and splits in SQL, and forests and boosting on top."""
from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..session import cut, staged


@dataclass(frozen=True)
class Sparse:
    """Features as a pair of array columns: indices from 0 to `size` - 1, and values; an index not listed is 0."""

    idx: str
    val: str
    size: int

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, f: int) -> str:
        return f"{self.val}[{f}]"


Features = list[str] | Sparse


def feature_value(features: Features, f: int) -> Column:
    """The value by which a row is trained and scored: null and NaN count as 0."""
    if isinstance(features, Sparse):
        x = F.get(F.col(features.val), F.array_position(F.col(features.idx), f).cast("int") - 1)
    else:
        x = F.col(features[f])
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def _columns(features: Features) -> list[str]:
    return [features.idx, features.val] if isinstance(features, Sparse) else list(features)


@dataclass
class Node:
    """A leaf (no feature) or a split: rows with value < threshold go left."""

    prediction: float
    count: float
    impurity: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    stats: tuple = field(default=(), repr=False)

    def depth(self) -> int:
        return 0 if self.feature < 0 else 1 + max(self.left.depth(), self.right.depth())


def tree_expression(node: Node, features: Features, leaf=lambda n: n.prediction) -> Column:
    """The tree as nested conditions, which Spark compiles; null and NaN features count as 0, as in training."""
    if node.feature < 0:
        return F.lit(float(leaf(node)))
    return F.when(feature_value(features, node.feature) < node.threshold, tree_expression(node.left, features, leaf)).otherwise(tree_expression(node.right, features, leaf))


def print_tree(node: Node, features: Features, indent: str = "") -> str:
    if node.feature < 0:
        return f"{indent}predict {node.prediction:g} ({node.count:g} rows)\n"
    name = features[node.feature]
    return f"{indent}if {name} < {node.threshold:g}\n{print_tree(node.left, features, indent + '  ')}{indent}else\n{print_tree(node.right, features, indent + '  ')}"


def _long(df: DataFrame, features: Features) -> DataFrame:
    """(f, x) of every feature of every row; of sparse features only those listed."""
    if isinstance(features, Sparse):
        e = df.select(F.explode(F.arrays_zip(F.col(features.idx).alias("i"), F.col(features.val).alias("v"))).alias("e")).select(F.col("e.i").cast("int").alias("f"), F.col("e.v").cast("double").alias("x"))
        return e.filter((F.col("f") >= 0) & (F.col("f") < features.size) & F.col("x").isNotNull() & ~F.isnan("x"))
    return df.select(F.posexplode(F.array(*[feature_value(features, f) for f in range(len(features))])).alias("f", "x"))


def split_points(df: DataFrame, features: Features, max_bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """At most `max_bins` - 1 thresholds of each feature: midway between all its values if it has at most `max_bins`, else between
    neighbouring quantiles. One aggregate for all features; features x bins numbers come to the driver."""
    long = _long(df, features)
    probs = F.array(*[F.lit(i / max_bins) for i in range(max_bins + 1)])
    rows = long.groupBy("f").agg(F.percentile_approx("x", probs, F.lit(accuracy)).alias("q"), F.approx_count_distinct("x", 0.02).alias("n"))
    # a few more than max_bins by the estimate are counted exactly
    few = long.join(F.broadcast(rows.filter(F.col("n") <= max_bins * 1.2 + 2).select("f")), "f").groupBy("f").agg(F.collect_set("x").alias("all"))
    out: list[list[float]] = [[] for _ in range(len(features))]
    for r in rows.join(few, "f", "left").collect():
        values = r["all"] if r["all"] is not None and len(r["all"]) <= max_bins else r["q"]
        q = sorted({*values, *([0.0] if isinstance(features, Sparse) else [])})
        out[r["f"]] = [(a + b) / 2 for a, b in zip(q, q[1:])]
    return out


@dataclass
class CART:
    """A classification (`gini`) or regression (`variance`) tree. `min_node_size` rows must remain on each side."""

    impurity: str = "variance"
    max_depth: int = 10
    max_bins: int = 32
    min_node_size: float = 15
    min_info_gain: float = 1e-6
    #: Share of the features considered at each node.
    col_rate: float = 1.0
    seed: int = 42

    def fit(self, df: DataFrame, features: Features, label: str, weight: str | None = None, points: list[list[float]] | None = None) -> Node:
        """Grow level by level: one scan, one aggregate over (leaf, feature, bin), and the choice of splits in SQL; one row per
        open leaf comes to the driver. Rows of a null label or of no weight don't count."""
        points = points if points is not None else split_points(df, features, self.max_bins)
        y, w = F.col(label).cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0))
        # names of their own first: a feature may be called like one of these
        rows = binned(df, features, points, F.lit(0).alias("__tree"), y.alias("__y"), w.alias("__w")).toDF("tree", "y", "w", "e")
        return self.grow(staged(rows.filter(F.col("y").isNotNull() & (F.col("w") > 0)), "binned"), points, 1)[0]

    def grow(self, rows: DataFrame, points: list[list[float]], trees: int) -> list[Node]:
        """The trees of (tree, y, w, e), all at once: `e` holds the (feature, bin) of each row that are not the bin of 0."""
        names = self._statistics(rows)
        zero = rows.sparkSession.createDataFrame([(f, bisect_right(p, 0.0)) for f, p in enumerate(points)], "f int, zero int")
        roots: list[Node | None] = [None] * trees
        open_: dict[tuple[int, int], Node] = {}
        rows = rows.withColumn("leaf", F.lit(0))
        for depth in range(self.max_depth + 1):
            nxt: list[tuple] = []
            fresh: dict[tuple[int, int], Node] = {}
            for r in self._splits(rows, names, zero, len(points), depth).collect():  # a row per open leaf
                total = [r[n] for n in names]
                node = open_.get((r["tree"], r["leaf"]))
                if node is None:
                    node = roots[r["tree"]] = self._node(total, names)
                best = r["best"]
                if depth == self.max_depth or best is None:
                    continue
                left = list(best["left"])
                node.feature, node.threshold = best["f"], points[best["f"]][best["b"]]
                node.left, node.right = self._node(left, names), self._node([t - v for t, v in zip(total, left)], names)
                no = 2 * r["leaf"] + 1
                fresh[r["tree"], no], fresh[r["tree"], no + 1] = node.left, node.right
                nxt.append((r["tree"], r["leaf"], best["f"], best["b"], bisect_right(points[best["f"]], 0.0)))
            open_ = fresh
            if not nxt:
                break
            chosen = rows.sparkSession.createDataFrame(nxt, "tree int, leaf int, sf int, sb int, sz int")  # a row per open leaf
            at = F.coalesce(F.get(F.filter("e", lambda x: x["f"] == F.col("sf")), F.lit(0))["b"], F.col("sz"))
            rows = rows.join(F.broadcast(chosen), ["tree", "leaf"]).select("tree", "y", "w", "e", (2 * F.col("leaf") + F.when(at <= F.col("sb"), 1).otherwise(2)).alias("leaf"))
            if depth % 4 == 3:
                rows = cut(rows)
        return [n if n is not None else Node(0.0, 0.0, 0.0) for n in roots]

    def _statistics(self, rows: DataFrame) -> dict[str, Column]:
        """Named sums by which nodes are judged: weight by class, or weight, sum and sum of squares."""
        y, w = F.col("y"), F.col("w")
        if self.impurity == "gini":
            classes = sorted(r[0] for r in rows.select("y").distinct().collect())
            self._classes = classes
            return {f"c{k}": F.sum(F.when(y == c, w).otherwise(0.0)) for k, c in enumerate(classes)}
        return {"n": F.sum(w), "s": F.sum(w * y), "q": F.sum(w * y * y)}

    def _size(self, v: list):
        """Weight and impurity times weight of sums, numbers or columns."""
        if self.impurity == "gini":
            n = reduce(lambda a, b: a + b, v)
            return n, n - reduce(lambda a, b: a + b, [x * x for x in v]) / (F.nullif(n, F.lit(0.0)) if isinstance(n, Column) else (n or 1.0))
        n = v[0]
        return n, v[2] - v[1] * v[1] / (F.nullif(n, F.lit(0.0)) if isinstance(n, Column) else (n or 1.0))

    def _splits(self, rows: DataFrame, names: dict[str, Column], zero: DataFrame, features: int, depth: int) -> DataFrame:
        """(tree, leaf, sums, best(f, b, left)): of every leaf its sums and its best split, null if there is none."""
        keys = ["tree", "leaf"]
        totals = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in names.items()])
        if depth == self.max_depth:
            return totals.withColumn("best", F.lit(None))
        long = rows.select(*keys, "y", "w", F.inline("e")).groupBy(*keys, "f", "b").agg(*[c.alias(n) for n, c in names.items()])
        of = totals.select(*keys, *[F.col(n).alias(f"t_{n}") for n in names])  # a row per open leaf
        # rows that list no bin of a feature are in its bin of 0
        rest = long.groupBy(*keys, "f").agg(*[F.sum(n).alias(n) for n in names]).join(F.broadcast(of), keys).join(F.broadcast(zero), "f")
        rest = rest.select(*keys, "f", F.col("zero").alias("b"), *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names])
        w = Window.partitionBy(*keys, "f").orderBy("b")
        bins = long.union(rest).withColumns({n: F.sum(n).over(w) for n in names}).join(F.broadcast(of), keys)
        if self.col_rate < 1.0:
            order = Window.partitionBy(*keys).orderBy(F.xxhash64("f", "tree", "leaf", F.lit(self.seed)))
            bins = bins.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= max(1, math.ceil(self.col_rate * features)))
        left, right = [F.col(n) for n in names], [F.col(f"t_{n}") - F.col(n) for n in names]
        (ln, li), (rn, ri), (tn, ti) = self._size(left), self._size(right), self._size([F.col(f"t_{n}") for n in names])
        gain = (ti - li - ri) / tn
        ok = bins.withColumn("gain", gain).filter((ln >= self.min_node_size) & (rn >= self.min_node_size) & (F.col("gain") >= self.min_info_gain))
        best = ok.groupBy(*keys).agg(F.max_by(F.struct("f", "b", F.array(*left).alias("left")), F.struct(F.round("gain", 12), -F.col("f"), -F.col("b"))).alias("best"))
        return totals.join(best, keys, "left")

    def _node(self, v: list, names: dict) -> Node:
        n, i = self._size(v)
        if self.impurity == "gini":
            value = self._classes[max(range(len(v)), key=lambda k: v[k])]
            return Node(float(value), n, i / n if n > 0 else 1.0, stats=tuple(zip(self._classes, v)))
        return Node(float(v[1] / n if n else 0.0), n, max(0.0, i / n) if n > 0 else 1.0, stats=tuple(v))


def binned(df: DataFrame, features: Features, points: list[list[float]], *columns: Column) -> DataFrame:
    """The given columns, and `__e` array<struct<f, b>>: the bins of a row's features, without those that are the bin of 0."""
    kind = "array<struct<f:int,b:int>>"
    if isinstance(features, Sparse):
        # the thresholds come as one row: thousands of literals would swell the plan
        row = df.sparkSession.createDataFrame([([[float(t) for t in p] for p in points], [bisect_right(p, 0.0) for p in points])], "__cuts array<array<double>>, __zero array<int>")
        df, cuts, zero = df.crossJoin(F.broadcast(row)), F.col("__cuts"), F.col("__zero")
        at = lambda i, v: F.size(F.filter(F.get(cuts, i.cast("int")), lambda t: t <= v))
        bins = F.zip_with(features.idx, features.val, lambda i, v: F.struct(i.cast("int").alias("f"), at(i, v).alias("b"), v.cast("double").alias("x")))
        kept = F.filter(bins, lambda e: (e["f"] >= 0) & (e["f"] < len(points)) & e["x"].isNotNull() & ~F.isnan(e["x"]) & (e["b"] != F.get(zero, e["f"])))
        return df.select(*columns, F.coalesce(F.transform(kept, lambda e: F.struct(e["f"].alias("f"), e["b"].alias("b"))), F.array().cast(kind)).alias("__e"))
    used = [f for f, p in enumerate(points) if p]
    if not used:
        return df.select(*columns, F.array().cast(kind).alias("__e"))
    infinity = float("inf")
    found = Bucketizer(splitsArray=[[-infinity, *points[f], infinity] for f in used], inputCols=[f"__v{f}" for f in used], outputCols=[f"__b{f}" for f in used])
    wide = found.transform(df.select("*", *[feature_value(features, f).alias(f"__v{f}") for f in used]))
    each = [F.when(F.col(f"__b{f}") != bisect_right(points[f], 0.0), F.struct(F.lit(f).alias("f"), F.col(f"__b{f}").cast("int").alias("b"))) for f in used]
    return wide.select(*columns, F.filter(F.array(*each), lambda e: e.isNotNull()).alias("__e"))


@dataclass
class Ensemble:
    """Trees with weights; `combine` is `mean`, `vote`, `sum` or (per class) `softmax`, whose ties (to nine decimals) go to the lesser class."""

    trees: list
    features: Features
    combine: str
    classes: tuple = ()

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.combine == "softmax":
            scores = [reduce(lambda a, b: a + b, [tree_expression(r[k], self.features) for r in self.trees], F.lit(0.0)) for k in range(len(self.classes))]
            best = F.array_max(F.array(*[F.struct(F.round(s, 9).alias("s"), F.lit(-k).alias("k")) for k, s in enumerate(scores)]))
            return df.withColumn(out, F.get(F.array(*map(F.lit, self.classes)), -best["k"]))
        each = [tree_expression(t, self.features) for t in self.trees]
        if self.combine == "vote":
            return df.withColumn("__v", F.array(*each)).withColumn(out, F.expr("""
              element_at(array_sort(transform(array_distinct(__v), c -> struct(-size(filter(__v, x -> x = c)) AS n, c AS c))), 1).c""")).drop("__v")
        total = reduce(lambda a, b: a + b, each)
        return df.withColumn(out, total / len(each) if self.combine == "mean" else total)


def poisson_weight(key: str, tree: int | Column, rate: float, seed: int) -> Column:
    """A repeatable Poisson draw for (row, tree), at most 6."""
    u = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(tree) if isinstance(tree, int) else tree.cast("string"), F.lit(str(seed))))
    p, cum, steps, weight = math.exp(-rate), 0.0, [], F.lit(6.0)
    for k in range(6):
        cum += p
        steps.append((k, cum))
        p *= rate / (k + 1)
    for k, c in reversed(steps):
        weight = F.when(u < c, float(k)).otherwise(weight)
    return weight


def random_forest(df: DataFrame, features: Features, label: str, key: str, cart: CART | None = None, num_trees: int = 20, row_rate: float = 0.6, col_rate: float = 0.6, points: list[list[float]] | None = None) -> Ensemble:
    """Trees on Poisson(row_rate) row weights, drawn by a hash of (key, tree), and a share of the features at each node; all trees are
    grown at once."""
    cart = cart or CART()
    points = points if points is not None else split_points(df, features, cart.max_bins)
    rows = binned(df, features, points, F.col(key).alias("__k"), F.col(label).cast("double").alias("__y")).toDF("k", "y", "e")
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1)))).select("tree", "y", poisson_weight("k", F.col("tree"), row_rate, cart.seed).alias("w"), "e").filter(F.col("y").isNotNull() & (F.col("w") > 0))
    grown = CART(cart.impurity, cart.max_depth, cart.max_bins, cart.min_node_size, cart.min_info_gain, col_rate, cart.seed)
    return Ensemble(grown.grow(staged(rows, "forest"), points, num_trees), features, "vote" if cart.impurity == "gini" else "mean")


def gbrt(df: DataFrame, features: Features, label: str, cart: CART | None = None, num_round: int = 10, learn_rate: float = 0.02, every: int = 5, watch: DataFrame | None = None) -> tuple[Ensemble, list]:
    """Boosted regression: the first tree counts whole, later ones on residuals times `learn_rate`.

    With the RMSE after each round, or pairs of it and that of the table `watch`. Rows are binned once for all rounds.
    """
    cart = cart or CART()
    points = split_points(df, features, cart.max_bins)
    rows = staged(binned(df, features, points, *map(F.col, _columns(features)), F.col(label).cast("double").alias("__t")).filter(F.col("__t").isNotNull()), "boosted").withColumn("__p", F.lit(0.0))
    trees, errors = [], []
    for k in range(num_round):
        tree = cart.grow(rows.select(F.lit(0).alias("tree"), (F.col("__t") - F.col("__p")).alias("y"), F.lit(1.0).alias("w"), F.col("__e").alias("e")), points, 1)[0]
        _scale(tree, 1.0 if k == 0 else learn_rate)
        trees.append(tree)
        rows = rows.withColumn("__p", F.col("__p") + tree_expression(tree, features))
        if (k + 1) % every == 0:
            rows = cut(rows)
        errors.append(rows.agg(F.sqrt(F.avg(F.pow(F.col("__t") - F.col("__p"), 2)))).first()[0])
        if watch is not None:
            seen = Ensemble(trees, features, "sum").transform(watch, "__p")
            errors[-1] = (errors[-1], seen.agg(F.sqrt(F.avg(F.pow(F.col(label).cast("double") - F.col("__p"), 2)))).first()[0])
    return Ensemble(trees, features, "sum"), errors


def _scale(node: Node, rate: float) -> None:
    node.prediction *= rate
    if node.feature >= 0:
        _scale(node.left, rate)
        _scale(node.right, rate)


def gbdt(df: DataFrame, features: Features, label: str, cart: CART | None = None, num_round: int = 10, points: list[list[float]] | None = None) -> Ensemble:
    """Multi-class boosting: per round one tree per class on the softmax residuals, all classes' trees grown at once; a leaf's value is
    sum(r) / sum(|r| (1 - |r|)) * (K - 1) / K. Predicts the class of the greatest sum. Rows are binned once."""
    cart = cart or CART()
    points = points if points is not None else split_points(df, features, cart.max_bins)
    y = F.col(label).cast("double")
    classes = tuple(r[0] for r in df.select(y.alias("y")).filter("y IS NOT NULL").distinct().orderBy("y").collect())
    k = len(classes)
    rows = staged(binned(df, features, points, *map(F.col, _columns(features)), y.alias("__t")).filter(F.col("__t").isNotNull()), "boosted").withColumn("__s", F.array_repeat(F.lit(0.0), k))
    rounds = []
    for _ in range(num_round):
        e = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
        total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        truth = F.array(*[(F.col("__t") == c).cast("double") for c in classes])
        rows = cut(rows.withColumn("__r", F.zip_with(truth, e, lambda t, x: t - x / total)))
        trees = cart.grow(rows.select(F.posexplode("__r").alias("tree", "y"), F.lit(1.0).alias("w"), F.col("__e").alias("e")), points, k)
        leaves = [_leaves(t) for t in trees]
        number = F.array(*[_leaf_number(t, features, {id(n): j for j, n in enumerate(ls)}) for t, ls in zip(trees, leaves)])
        each = rows.select(F.posexplode(F.arrays_zip(number.alias("leaf"), F.col("__r").alias("r"))).alias("tree", "x")).select("tree", "x.leaf", "x.r")
        for tree, leaf, a, b in each.groupBy("tree", "leaf").agg(F.sum("r"), F.sum(F.abs("r") * (1 - F.abs("r")))).collect():  # a row per leaf
            leaves[tree][leaf].prediction = a / b * (k - 1) / k if b > 1e-12 else 0.0
        rounds.append(trees)
        rows = rows.withColumn("__s", F.zip_with("__s", F.array(*[tree_expression(t, features) for t in trees]), lambda s, x: s + x)).drop("__r")
    return Ensemble(rounds, features, "softmax", classes)


def _leaves(n: Node) -> list[Node]:
    return [n] if n.feature < 0 else _leaves(n.left) + _leaves(n.right)


def _leaf_number(n: Node, features: Features, number: dict[int, int]) -> Column:
    if n.feature < 0:
        return F.lit(number[id(n)])
    return F.when(feature_value(features, n.feature) < n.threshold, _leaf_number(n.left, features, number)).otherwise(_leaf_number(n.right, features, number))


def feature_gain(node: Node, features: Features) -> dict[str, float]:
    """Impurity decrease by feature, weighted by rows."""
    if node.feature < 0:
        return {}
    own = node.count * node.impurity - node.left.count * node.left.impurity - node.right.count * node.right.impurity
    out = {features[node.feature]: own}
    for child in (node.left, node.right):
        for k, v in feature_gain(child, features).items():
            out[k] = out.get(k, 0.0) + v
    return out


def cumulative_bins(df: DataFrame, feature: str, label: str, points: list[float]) -> DataFrame:
    """(bin, n, cum_n, cum_sum): the prefix sums from which the split gains of one feature are computed, as a table."""
    at = F.size(F.filter(F.array(*map(F.lit, points)), lambda t: t <= F.col(feature).cast("double")))
    h = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of max_bins rows
    return h.select("bin", "n", F.sum("n").over(w).alias("cum_n"), F.sum("s").over(w).alias("cum_sum"))
