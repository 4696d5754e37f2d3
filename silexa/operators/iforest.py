"""Isolation forest: one task group per tree on a hash sample, scores by vectorised walks over node arrays."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, staged

EULER = 0.5772156649
_NODES = "tree int, node int, feature int, threshold double, left int, right int, size bigint"


def path_correction(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows: c(n) = 2 (ln(n-1) + gamma) - 2 (n-1)/n, 1 for 2, 0 below."""
    n = np.asarray(n, float)
    m = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(m - 1) + EULER) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size) in pre-order; leaves have feature -1. Constant features are skipped."""
    out: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        rows, level, parent, side = stack.pop()
        no = len(out)
        if parent >= 0:
            out[parent][3 + side] = no
        out.append([no, -1, 0.0, -1, -1, len(rows)])
        if level >= depth or len(rows) <= 1:
            continue
        part = x[rows]
        lo, hi = part.min(0), part.max(0)
        live = np.flatnonzero(hi > lo)
        if not len(live):
            continue
        f = int(rng.choice(live))
        t = rng.uniform(lo[f], hi[f])
        left = part[:, f] <= t if t <= lo[f] else part[:, f] < t
        out[no][1], out[no][2] = f, float(t)
        stack.append((rows[~left], level + 1, no, 1))
        stack.append((rows[left], level + 1, no, 0))
    return [tuple(r) for r in out]


@dataclass
class IsolationForest:
    """Parameters; `max_samples` and `max_features` up to 1.0 are fractions, above it numbers."""

    num_trees: int = 100
    max_samples: float = 256
    max_features: float = 1.0
    max_depth: int = 10
    contamination: float = 0.1
    bootstrap: bool = False
    seed: int = 123456
    relative_error: float = 0.0

    def _grow(self, df: DataFrame, features: list[str], key: str | None = None) -> IsolationForestModel:
        """Grow the trees: (tree, node, feature, threshold, left, right, size) rows.

        Each tree's sample is drawn by a hash of (row, tree, seed): rows below a rate are exploded to their trees and the
        `size` least hashes kept, so sampling is distributed, repeatable and without replacement; with `bootstrap` a row's
        weight is a Poisson draw of that hash. A sample is bounded by `max_samples` (give a number for large tables).
        Null and NaN features count as 0.
        """
        x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
        rows = df.select((F.xxhash64(key) if key else F.xxhash64(*features, F.monotonically_increasing_id())).alias("k"), x.alias("x"))
        n = rows.count()
        size = int(min(n, max(1, self.max_samples * n if self.max_samples <= 1 else self.max_samples)))
        rate = min(1.0, (size + 6 * math.sqrt(size) + 10) / max(n, 1))
        trees = F.sequence(F.lit(0), F.lit(self.num_trees - 1))
        unit = lambda t: (F.pmod(F.xxhash64("k", t, F.lit(self.seed)), F.lit(2**40)) + 0.5) / 2.0**40
        chosen = F.filter(trees, lambda t: unit(t) < rate)
        rows = rows.withColumn("tree", F.explode(chosen)).withColumn("u", unit(F.col("tree")))
        seed, boot, share, depth = self.seed, self.bootstrap, self.max_features, self.max_depth

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rng = np.random.default_rng((seed, tree))
            pdf = pdf.sort_values(["u", "k"]).head(size)
            x = np.array(pdf["x"].tolist(), float)
            if boot:
                x = x[rng.integers(0, len(x), len(x))]
            d = x.shape[1]
            take = d if share == 1.0 else max(1, round(share * d if share < 1 else min(share, d)))
            used = np.sort(rng.choice(d, take, replace=False))
            nodes = grow(x[:, used], min(depth, max(1, math.ceil(math.log2(max(len(x), 2))))), rng)
            return pd.DataFrame([(tree, no, int(used[f]) if f >= 0 else -1, t, a, b, s) for no, f, t, a, b, s in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

        nodes = cut(rows.groupBy("tree").applyInPandas(one, _NODES))
        return IsolationForestModel(nodes, list(features), size, None)

    def fit(self, df: DataFrame, features: list[str], key: str | None = None) -> IsolationForestModel:
        """Grow the trees and find the score above which a row is an anomaly."""
        return self.fit_transform(df, features, key)[0]

    def fit_transform(self, df: DataFrame, features: list[str], key: str | None = None) -> tuple[IsolationForestModel, DataFrame]:
        """The model and the table it was fitted on with `anomaly_score` and `prediction`: rows are scored once, and written."""
        model = self._grow(df, features, key)
        scored = staged(model.score(df), "scores")
        q = scored.approxQuantile("anomaly_score", [1 - self.contamination], self.relative_error)
        model.threshold = q[0] if q else None
        return model, scored.withColumn("prediction", (F.col("anomaly_score") > F.lit(model.threshold)).cast("double"))


@dataclass
class IsolationForestModel:
    """The node table, its feature names, the sample size, and the score above which a row is an anomaly."""

    nodes: DataFrame
    features: list[str]
    size: int
    threshold: float | None

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with `anomaly_score` = 2 ** (-mean path / c(sample size)).

        The nodes go to the tasks: at most trees x 2 x sample size rows, whatever the table.
        """
        t = self.nodes.orderBy("tree", "node").toPandas()
        arrays = [tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size")) for _, g in t.groupby("tree")]
        norm = max(float(path_correction(self.size)), 1e-12)

        @F.pandas_udf("double")
        def walk(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in it:
                x = np.stack([c.to_numpy() for c in (columns if isinstance(columns, tuple) else (columns,))], axis=1)
                total = np.zeros(len(x))
                for feature, threshold, left, right, size in arrays:
                    at, depth = np.zeros(len(x), int), np.zeros(len(x))
                    live = np.flatnonzero(feature[at] >= 0)
                    while len(live):
                        node = at[live]
                        f = feature[node]
                        go = np.where(x[live, f] < threshold[node], left[node], right[node])
                        at[live] = go
                        depth[live] += 1
                        live = live[feature[go] >= 0]
                    total += depth + path_correction(size[at])
                yield pd.Series(2.0 ** (-(total / max(len(arrays), 1)) / norm))

        return df.withColumn("anomaly_score", walk(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores with `prediction` 1.0 above the model's threshold."""
        return self.score(df).withColumn("prediction", (F.col("anomaly_score") > F.lit(self.threshold)).cast("double"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        spark.createDataFrame([(self.features, self.size, self.threshold)], "features array<string>, size int, threshold double").write.mode("overwrite").json(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForestModel:
        m = spark.read.schema("features array<string>, size int, threshold double").json(f"{path}/metadata").first()
        return IsolationForestModel(spark.read.parquet(f"{path}/nodes"), list(m["features"]), m["size"], m["threshold"])

    def summary(self, df: DataFrame) -> DataFrame:
        """(anomalies, rows)"""
        return self.transform(df).agg(F.coalesce(F.sum("prediction"), F.lit(0.0)).cast("bigint").alias("anomalies"), F.count("*").alias("rows"))
