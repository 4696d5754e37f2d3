"""Descriptive statistics and parameter estimation: every operator is one fused aggregate over one scan."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: The metrics of the vector summary, in report order.
METRICS = ("mean", "sum", "variance", "std", "count", "num_non_zeros", "max", "min", "norm_l2", "norm_l1", "range", "group_interval", "variation_coefficient")


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _metric(name: str, c: str, groups: int) -> Column:
    x = _num(c)
    match name:
        case "mean":
            return F.avg(x)
        case "sum":
            return F.sum(x)
        case "variance":
            return F.var_samp(x)
        case "std":
            return F.stddev_samp(x)
        case "count":
            return F.count(x).cast("double")
        case "num_non_zeros":
            return F.sum(F.when(x != 0, 1).otherwise(0)).cast("double")
        case "max":
            return F.max(x)
        case "min":
            return F.min(x)
        case "norm_l2":
            return F.sqrt(F.sum(x * x))
        case "norm_l1":
            return F.sum(F.abs(x))
        case "range":
            return F.max(x) - F.min(x)
        case "group_interval":
            return (F.max(x) - F.min(x)) / groups
        case "variation_coefficient":
            return F.stddev_samp(x) / F.nullif(F.avg(x), F.lit(0.0))
    raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")


def _unpivot(row: DataFrame, columns: list[str], metrics: list[str], name: str = "column") -> DataFrame:
    """A single row of `column__metric` cells as one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"`{c}__{m}`").alias(m) for m in metrics]) for c in columns])
    return row.select(F.inline(cells))


def summary(df: DataFrame, columns: list[str], metrics: list[str] | None = None, groups: int = 10) -> DataFrame:
    """Multi-metric summary: one row per column with the requested METRICS (all by default), in one aggregate.

    Nulls are skipped; `range` is max - min whatever the metric order, `variation_coefficient` and `group_interval`
    don't depend on which other metrics are asked for. An empty table gives null metrics and counts of 0.
    """
    metrics = list(metrics or METRICS)
    row = df.agg(*[_metric(m, c, groups).alias(f"{c}__{m}") for c in columns for m in metrics])
    return _unpivot(row, columns, metrics)


def weighted_summary(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """Weighted mean and unbiased variance (reliability weights: denominator W - sum(w^2) / W); weights <= 0 don't count."""
    w = F.when(_num(weight) > 0, _num(weight))

    def parts(c: str) -> list[Column]:
        x = _num(c)
        ok = F.when(x.isNotNull(), w)
        return [F.sum(ok).alias(f"{c}__w"), F.sum(ok * ok).alias(f"{c}__ww"), F.sum(ok * x).alias(f"{c}__wx"), F.sum(ok * x * x).alias(f"{c}__wxx")]

    row = df.agg(*[p for c in columns for p in parts(c)])
    wide = _unpivot(row, columns, ["w", "ww", "wx", "wxx"])
    mean = F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))
    variance = (F.col("wxx") - mean * mean * F.col("w")) / F.nullif(F.col("w") - F.col("ww") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0))
    return wide.select("column", F.col("w").alias("weight_sum"), mean.alias("mean"), F.greatest(variance, F.lit(0.0)).alias("variance"))


def transpose_metrics(summary_df: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows, input columns as columns, from `summary`'s rows (one per column)."""
    long = summary_df.select("column", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy("metric").pivot("column", columns).agg(F.first("value"))


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per column: (column, bin, lo, hi, count), empty bins included.

    Bins are left-closed and the last one is closed; a constant column has all rows in bin 0. One pass for the bounds, one
    for the counts; rows are combined to (column, bin) before any shuffle.
    """
    bounds = summary(df, columns, ["min", "max"]).withColumn("width", (F.col("max") - F.col("min")) / bins)
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _num(c).alias("x")) for c in columns]))).filter(F.col("x").isNotNull())
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("min")) / F.nullif(F.col("width"), F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    counts = values.join(F.broadcast(bounds), "column").groupBy("column", at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = bounds.filter(F.col("min").isNotNull()).select("column", "min", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.col("min") + F.col("bin") * F.col("width")
    return grid.join(counts, ["column", "bin"], "left").select("column", "bin", lo.alias("lo"), (lo + F.col("width")).alias("hi"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def statistics_report(df: DataFrame, columns: list[str], metrics: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Summary with each column's histogram as a map from `lo-hi` labels to counts."""
    h = histogram(df, columns, bins)
    label = F.format_string("%d:%.2f-%.2f", "bin", "lo", "hi")
    density = h.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label.alias("k"), "count")))).alias("density"))
    return summary(df, columns, metrics).join(density, "column", "left")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, count) of every distinct value."""
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _num(c).alias("x")) for c in columns]))).filter(F.col("x").isNotNull())
    return values.groupBy("column", "x").agg(F.count("*").alias("count"))


def ranked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, count, cum, n): every distinct value with its count and the running count up to it.

    Rows are combined to distinct values before any shuffle; running counts go over 64 ranges of values in parallel, each
    starting from the counts of the ranges below it, so that no task holds or orders all values of a column.
    """
    counts = staged(value_counts(df, columns), "values")
    cuts = counts.groupBy("column").agg(F.percentile_approx("x", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(10_000)).alias("cuts"))
    counts = counts.join(F.broadcast(cuts), "column")  # a row per column
    counts = counts.withColumn("r", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    below = Window.partitionBy("column").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("column", "r").agg(F.sum("count").alias("s"))
    sums = sums.select("column", "r", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy("column")).alias("n"))
    inside = Window.partitionBy("column", "r").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.join(F.broadcast(sums), ["column", "r"]).select("column", "x", "count", (F.sum("count").over(inside) + F.col("base")).alias("cum"), "n")


def central_position(df: DataFrame, columns: list[str], metrics: list[str] = ("mode", "median", "mean"), quantiles: list[float] = (0.25, 0.5, 0.75, 1.0), accuracy: int | None = 10_000) -> DataFrame:
    """(metric, one column each): mode (ties: the least value), median, any built-in aggregate, and `quantile-p` rows.

    Median and nearest-rank quantiles have a relative rank error of 1 / accuracy, from the one aggregate that gives the other
    metrics; only the mode needs the counts of all values. With `accuracy` None they are exact, from the same counts.
    """
    known = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_samp, "variance": F.var_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}
    for m in metrics:
        if m not in known and m not in ("mode", "median"):
            raise ValueError(f"unknown aggregate {m!r}")
    direct: dict[str, list[Column]] = {m: [known[m](_num(c)) for c in columns] for m in metrics if m in known}
    ranked: dict[str, Column] = {}
    rank = lambda r: (F.col("cum") - F.col("count") < r) & (F.col("cum") >= r)
    if "mode" in metrics:
        ranked["mode"] = F.max_by("x", F.struct("count", -F.col("x")))
    if "median" in metrics and accuracy:
        half = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(accuracy))
        direct["median"] = [(half(_num(c)) - half(-_num(c))) / 2 for c in columns]  # the mean of the lower and the upper one
    elif "median" in metrics:
        lo, hi = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
        ranked["median"] = (F.max(F.when(rank(lo), F.col("x"))) + F.max(F.when(rank(hi), F.col("x")))) / 2
    for p in quantiles:
        if accuracy:
            direct[f"quantile-{p}"] = [F.percentile_approx(_num(c), F.lit(p), F.lit(accuracy)) for c in columns]
        else:
            ranked[f"quantile-{p}"] = F.max(F.when(rank(F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1))), F.col("x")))
    parts = []
    if direct:
        row = df.agg(*[e.cast("double").alias(f"{m}__{c}") for m, es in direct.items() for c, e in zip(columns, es)])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"`{m}__{c}`").alias(c) for c in columns]) for m in direct]))))
    if ranked:
        per = (value_counts(df, columns) if accuracy else ranked_values(df, columns)).groupBy("column").agg(*[e.alias(m) for m, e in ranked.items()])
        long = per.select("column", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("v")) for m in ranked])))
        parts.append(long.groupBy("metric").pivot("column", columns).agg(F.first("v")))
    return reduce(DataFrame.unionByName, parts)


def deviation(df: DataFrame, columns: list[str], metrics: list[str] = ("skewness", "kurtosis")) -> DataFrame:
    """(metric, one column each): population skewness and excess kurtosis, always with mean and sample std."""
    return central_position(df, columns, [*metrics, "mean", "stddev"], quantiles=())


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with a column `<c>_zscore` = (c - mean) / population std for each column; null where the std is 0.

    One 1-row aggregate is broadcast to the rows.
    """
    row = df.agg(*[a for i, c in enumerate(columns) for a in (F.avg(_num(c)).alias(f"__m{i}"), F.stddev_pop(_num(c)).alias(f"__s{i}"))])
    out = df.crossJoin(F.broadcast(row))
    out = out.withColumns({f"{c}_zscore": (_num(c) - F.col(f"__m{i}")) / F.nullif(F.col(f"__s{i}"), F.lit(0.0)) for i, c in enumerate(columns)})
    return out.select(*df.columns, *[f"{c}_zscore" for c in columns])


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, one column each): the sample covariance of every pair of columns, all from one aggregate."""
    cells = {(a, b): F.covar_samp(_num(a), _num(b)).alias(f"{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]}
    row = df.agg(*cells.values())
    at = lambda a, b: F.col(f"`{a}__{b}`" if (a, b) in cells else f"`{b}__{a}`")
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("dim"), *[at(a, b).alias(b) for b in columns]) for a in columns])))


def mean_estimation(df: DataFrame, columns: list[str]) -> DataFrame:
    return summary(df, columns, ["mean"])


def variance_estimation(df: DataFrame, columns: list[str]) -> DataFrame:
    return summary(df, columns, ["variance"])


def _two(a: DataFrame, b: DataFrame, columns: list[str], metric: str) -> DataFrame:
    first = summary(a, columns, [metric]).withColumnRenamed(metric, "first")
    return first.join(F.broadcast(summary(b, columns, [metric]).withColumnRenamed(metric, "second")), "column")  # a row per column


def mean_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column in `a` minus that in `b`."""
    return _two(a, b, columns, "mean").select("column", (F.col("first") - F.col("second")).alias("mean_difference"))


def variance_ratio(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance of each column in `a` over that in `b`; null where the latter is 0."""
    return _two(a, b, columns, "variance").select("column", (F.col("first") / F.nullif(F.col("second"), F.lit(0.0))).alias("variance_ratio"))


def ratio(df: DataFrame, column: str, value: str) -> DataFrame:
    """(ratio): share of rows whose `column`, as a string, equals `value`; null cells count as unequal."""
    return df.agg(F.avg(F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False)).cast("double")).alias("ratio"))


def ratio_difference(a: DataFrame, b: DataFrame, column: str, value: str) -> DataFrame:
    second = ratio(b, column, value).withColumnRenamed("ratio", "second")
    return ratio(a, column, value).crossJoin(F.broadcast(second)).select((F.col("ratio") - F.col("second")).alias("ratio_difference"))


def pivot(df: DataFrame, group: str, pivot_column: str, value: str, values: list | None = None) -> DataFrame:
    """Sum of `value` per group and pivot value; missing cells are 0."""
    g = df.groupBy(group)
    return (g.pivot(pivot_column, values) if values else g.pivot(pivot_column)).sum(value).na.fill(0)


def lower_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median): the lower of the two middle values, so always one that occurs."""
    row = df.agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(`{c}` AS DOUBLE))").alias(f"{c}__median") for c in columns])
    return _unpivot(row, columns, ["median"])


def counter(df: DataFrame, column: str) -> DataFrame:
    """(item, count)"""
    return df.groupBy(F.col(column).alias("item")).count()


def top_items(df: DataFrame, column: str, k: int) -> DataFrame:
    """The `k` most frequent items, ties by item."""
    return counter(df, column).orderBy(F.desc("count"), "item").limit(k)


def weighted_sum(columns: list[tuple[str, float]]) -> Column:
    """A linear combination, null cells as 0."""
    return reduce(lambda acc, cw: acc + F.coalesce(_num(cw[0]), F.lit(0.0)) * cw[1], columns, F.lit(0.0))
