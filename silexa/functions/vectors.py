"""Scalar functions on dense vectors (array<double>), sparse vectors (maps), and matrices in long form."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), f)


def dot(a: str | Column, b: str | Column) -> Column:
    return _fold(F.zip_with(_c(a), _c(b), lambda x, y: x * y), lambda s, x: s + x)


def total(a: str | Column) -> Column:
    return _fold(_c(a), lambda s, x: s + x)


def norm(a: str | Column, p: int = 2) -> Column:
    """L1 or L2 norm."""
    return _fold(_c(a), lambda s, x: s + F.abs(x)) if p == 1 else F.sqrt(_fold(_c(a), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 if a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def normalize(a: str | Column, p: int = 2) -> Column:
    """Divided by the norm; a zero vector stays."""
    n = norm(a, p)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / F.nullif(n, F.lit(0.0)))).otherwise(_c(a))


def softmax(a: str | Column) -> Column:
    top = F.array_max(_c(a))
    e = F.transform(_c(a), lambda x: F.exp(x - top))
    s = _fold(e, lambda acc, x: acc + x)
    return F.transform(_c(a), lambda x: F.exp(x - top) / s)


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def multiply(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def divide(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x / F.nullif(y, F.lit(0.0)))


def scale(a: str | Column, by: float | Column) -> Column:
    return F.transform(_c(a), lambda x: x * (F.lit(by) if isinstance(by, int | float) else by))


def argmax(a: str | Column) -> Column:
    """0-based, ties to the first."""
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def argmin(a: str | Column) -> Column:
    return (F.array_position(_c(a), F.array_min(_c(a))) - 1).cast("int")


def top(a: str | Column, n: int) -> Column:
    """array<struct<v, i>> of the `n` greatest values, ties to the lesser index."""
    pairs = F.array_sort(F.transform(_c(a), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(pairs, 1, n), lambda p: F.struct((-p["v"]).alias("v"), p["i"].alias("i")))


def outer(a: str | Column, b: str | Column) -> Column:
    """array<array<double>>"""
    return F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: x * y))


def equal(a: str | Column, b: str | Column, tolerance: float = 1e-8) -> Column:
    return (F.size(_c(a)) == F.size(_c(b))) & F.forall(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y) <= tolerance), lambda x: x)


def constant(n: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(value), n)


def random_uniform(n: int, seed: int = 42) -> Column:
    return F.array(*[F.rand(seed + i) for i in range(n)])


def random_normal(n: int, seed: int = 42) -> Column:
    return F.array(*[F.randn(seed + i) for i in range(n)])


# --- sparse: map<string|int, double> ------------------------------------------------------------------------------------
def sparse_get(m: str | Column, key: Column) -> Column:
    """0 if absent."""
    return F.coalesce(F.try_element_at(_c(m), key), F.lit(0.0))


def sparse_add(a: str | Column, b: str | Column) -> Column:
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def sparse_dot(a: str | Column, b: str | Column) -> Column:
    return _fold(F.map_values(F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))), lambda s, x: s + x)


def sparse_norm(m: str | Column) -> Column:
    return norm(F.map_values(_c(m)))


def sparse_compact(m: str | Column) -> Column:
    """Without zeros."""
    return F.map_filter(_c(m), lambda _, v: v != 0)


def sparse_scale(m: str | Column, by: float) -> Column:
    return F.transform_values(_c(m), lambda _, v: v * by)


def sparse_to_text(m: str | Column) -> Column:
    """`i:v,i:v`, keys ascending"""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(m))), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def sparse_to_dense(m: str | Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(_c(m), i), F.lit(0.0)))


def swap(m: str | Column) -> Column:
    """Keys and values exchanged; of equal values the least key stays."""
    entries = F.array_sort(F.map_entries(_c(m)))
    once = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda q: q["value"] == e["value"]))
    return F.map_from_entries(F.transform(once, lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))


# --- matrices in long form (i, j, v) --------------------------------------------------------------------------------------
def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joined on the inner index, summed per cell."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matrix_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of a matrix and a vector (i, v)"""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum("v").alias("v"))


def normalize_rows(a: DataFrame) -> DataFrame:
    """Each row's cells divided by their sum."""
    return a.withColumn("v", F.col("v") / F.nullif(F.sum("v").over(Window.partitionBy("i")), F.lit(0.0)))


def normalize_all(a: DataFrame) -> DataFrame:
    """All cells divided by their sum."""
    s = a.agg(F.sum("v").alias("s"))
    return a.crossJoin(F.broadcast(s)).select("i", "j", (F.col("v") / F.nullif(F.col("s"), F.lit(0.0))).alias("v"))
