"""Readers: tables in the usual formats, and the line formats of records, points, documents, ratings and graphs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json", "csv", "tsv")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header; the schema is inferred unless given (a given one spares a pass)."""
    r = spark.read.option("header", True).option("sep", delimiter).option("multiLine", multiline)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """parquet, json, csv or tsv; any other format is a ValueError."""
    match fmt:
        case "parquet":
            return spark.read.parquet(path)
        case "json":
            return spark.read.json(path)
        case "csv":
            return read_csv(spark, path, multiline=True)
        case "tsv":
            return read_csv(spark, path, "\t")
    raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def string_table(lines: DataFrame, separator: str = ",", width: int | None = None) -> DataFrame:
    """(_c0, _c1, ...) of strings from lines (value); the width is that of the widest line unless given."""
    f = F.split("value", f"\\Q{separator}\\E", -1)
    n = width or lines.agg(F.max(F.size(f))).first()[0] or 0
    return lines.select(*[F.get(f, F.lit(i)).alias(f"_c{i}") for i in range(n)])


def _entries(s: Column, separators: str, base: int) -> tuple[Column, Column]:
    """Indices (lowered by `base`) and values of `i:v` entries; malformed ones dropped."""
    parts = F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), separators), lambda x: x.rlike(r"^\d+:\S+$") & F.substring_index(x, ":", -1).try_cast("double").isNotNull())
    ids = F.transform(parts, lambda x: F.substring_index(x, ":", 1).cast("int") - base)
    return ids, F.transform(parts, lambda x: F.substring_index(x, ":", -1).cast("double"))


def read_libsvm(spark: SparkSession, path: str, classes: bool = True, shift: bool = True, base: int = 1) -> DataFrame:
    """(label, idx, val) of `label i:v ...` lines, indices 0-based (`base` is subtracted).

    With `classes`: of more than two distinct labels each is lowered by one, else negative labels become 0.
    """
    from ..operators.reshape import shift_labels

    lines = spark.read.text(path).filter(F.trim("value").rlike(r"^\S"))
    head = F.regexp_extract(F.trim("value"), r"^(\S+)", 1).try_cast("double")
    ids, vals = _entries(F.regexp_replace(F.trim("value"), r"^\S+", ""), r"\s+", base)
    df = lines.select(head.alias("label"), ids.alias("idx"), vals.alias("val")).filter(F.col("label").isNotNull())
    return shift_labels(df, "label") if classes and shift else df


def read_libfm(spark: SparkSession, path: str) -> DataFrame:
    """(label, idx, val) of `label i:v ...` lines, indices kept as they are."""
    return read_libsvm(spark, path, classes=False, base=0)


def _fields(lines: DataFrame, has_id: bool, has_label: bool, separator: str) -> tuple[Column, Column, Column]:
    """id ("" if absent), label (NaN if absent or no number) and the rest of a line."""
    want = 1 + has_id + has_label
    f = F.split(F.col("value"), f"\\Q{separator}\\E", want)
    key = F.coalesce(F.get(f, F.lit(0)), F.lit("")) if has_id else F.lit("")
    label = F.coalesce(F.get(f, F.lit(int(has_id))).try_cast("double"), F.lit(float("nan"))) if has_label else F.lit(float("nan"))
    return key, label, F.coalesce(F.get(f, F.lit(want - 1)), F.lit(""))


def parse_raw_docs(lines: DataFrame, has_id: bool = True, has_label: bool = True, separator: str = "\t") -> DataFrame:
    """(id, label, words array<string>) of lines `id<sep>label<sep>w w w`."""
    key, label, rest = _fields(lines, has_id, has_label, separator)
    return lines.select(key.alias("id"), label.alias("label"), F.filter(F.split(rest, r"\s+"), lambda x: x != "").alias("words"))


def parse_docs(lines: DataFrame, has_id: bool = True, has_label: bool = True, separator: str = "\t") -> DataFrame:
    """The same with words as ints; others are dropped."""
    d = parse_raw_docs(lines, has_id, has_label, separator)
    return d.withColumn("words", F.filter(F.transform("words", lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def parse_raw_points(lines: DataFrame, has_id: bool = True, has_label: bool = True, separator: str = "\t") -> DataFrame:
    """(id, label, features map<string,double>) of lines `id<sep>label<sep>name:v,name:v`; a name may hold colons, the last one counts."""
    key, label, rest = _fields(lines, has_id, has_label, separator)
    parts = F.filter(F.split(rest, r"[,\s]+"), lambda x: x.rlike(r"^.+:[^:]+$") & F.substring_index(x, ":", -1).try_cast("double").isNotNull())
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_replace(x, r":[^:]+$", "").alias("k"), F.substring_index(x, ":", -1).cast("double").alias("v")))
    # of repeated names the first counts
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return lines.select(key.alias("id"), label.alias("label"), F.map_from_entries(once).alias("features"))


def parse_labeled_points(lines: DataFrame, has_id: bool = True, has_label: bool = True, separator: str = "\t") -> DataFrame:
    """(id, label, idx, val) of lines `id<sep>label<sep>i:v,i:v`, also with blanks or bars between entries."""
    key, label, rest = _fields(lines, has_id, has_label, separator)
    ids, vals = _entries(rest, r"[,\s|]+", 0)
    return lines.select(key.alias("id"), label.alias("label"), ids.alias("idx"), vals.alias("val"))


def parse_rates(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    """(user, item, rating) of lines `rating user item`, or `user item` with a rating of 0."""
    f = F.split(F.trim("value"), separator)
    three = F.size(f) >= 3
    at = lambda i: F.get(f, F.lit(i))
    out = lines.filter(F.size(f) >= 2).select(F.when(three, at(1)).otherwise(at(0)).try_cast("int").alias("user"), F.when(three, at(2)).otherwise(at(1)).try_cast("int").alias("item"), F.when(three, at(0)).otherwise("0").try_cast("double").alias("rating"))
    return out.filter(F.col("user").isNotNull() & F.col("item").isNotNull())


def parse_separated_rates(lines: DataFrame, separator: str = "::") -> DataFrame:
    """(user, item, rating) of lines `user::item::rating[::time]`."""
    f = F.split(F.trim("value"), f"\\Q{separator}\\E")
    return lines.filter(F.size(f) >= 3).select(*[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate((("user", "int"), ("item", "int"), ("rating", "double")))])


def parse_svd_points(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """(id, label, and idx, val of user, item and global features) of lines `id<sep>label<sep>u,i,g`, each `i:v i:v`."""
    f = F.split("value", f"\\Q{separator}\\E", 3)
    g = F.split(F.coalesce(F.get(f, F.lit(2)), F.lit("")), ",", -1)
    cols = []
    for i, n in enumerate(("u", "i", "g")):
        ids, vals = _entries(F.coalesce(F.get(g, F.lit(i)), F.lit("")), r"\s+", 0)
        cols += [ids.alias(f"{n}_idx"), vals.alias(f"{n}_val")]
    return lines.select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).try_cast("double").alias("label"), *cols)


def rates_to_svd_points(rates: DataFrame) -> DataFrame:
    """Ratings as one-hot user and item features, with an id of `user item` and no global features."""
    one, none = F.array(F.lit(1.0)), F.array().cast("array<double>")
    return rates.select(
        F.concat_ws(" ", "user", "item").alias("id"), F.col("rating").alias("label"), F.array("user").alias("u_idx"), one.alias("u_val"), F.array("item").alias("i_idx"), one.alias("i_val"),
        F.array().cast("array<int>").alias("g_idx"), none.alias("g_val"),
    )


def parse_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, weight) of lines `src dst`, weight 1.0"""
    f = F.split(F.trim("value"), r"\s+")
    e = lines.select(F.get(f, F.lit(0)).try_cast("long").alias("src"), F.get(f, F.lit(1)).try_cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    return e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def parse_weighted_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, weight) of `(i,j,w)` or `i,j,w` lines"""
    f = F.split(F.regexp_replace("value", r"[()\s]", ""), ",")
    e = lines.select(F.get(f, F.lit(0)).try_cast("long").alias("src"), F.get(f, F.lit(1)).try_cast("long").alias("dst"), F.get(f, F.lit(2)).try_cast("double").alias("weight"))
    return e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def parse_predictions(lines: DataFrame) -> DataFrame:
    """(id, label, prediction) of lines `id<tab>label<tab>prediction`"""
    f = F.split("value", "\t")
    return lines.select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).try_cast("double").alias("label"), F.get(f, F.lit(2)).try_cast("double").alias("prediction"))


def json_to_labeled_points(df: DataFrame, label: str, classes: bool = True) -> DataFrame:
    """(label, features array<double>): the label column and all others in alphabetical order; rows with a null label dropped."""
    from ..operators.reshape import shift_labels

    names = sorted(c for c in df.columns if c != label)
    out = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("features"))
    return shift_labels(out, "label") if classes else out


def json_to_rates(df: DataFrame, user: str, item: str, rate: str = "") -> DataFrame:
    """(user, item, rating); without a rate column all ratings are 1."""
    r = F.col(rate).cast("double") if rate else F.lit(1.0)
    return df.select(F.col(user).cast("int").alias("user"), F.col(item).cast("int").alias("item"), r.alias("rating"))


def num_features(df: DataFrame, idx: str = "idx") -> int:
    """One more than the greatest index of sparse rows."""
    top = df.agg(F.max(F.array_max(idx))).first()[0]
    return 0 if top is None else int(top) + 1


def to_vector(df: DataFrame, size: int, idx: str = "idx", val: str = "val", out: str = "features") -> DataFrame:
    """`df` with a sparse ML vector column from a pair of arrays; zeros and nulls are left out, of equal indices the last counts."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    @F.udf(VectorUDT())  # no built-in expression makes a sparse vector
    def sparse(i, v):
        return Vectors.sparse(size, {int(k): float(x) for k, x in zip(i or [], v or []) if k is not None and x and 0 <= k < size})

    return df.withColumn(out, sparse(idx, val))
