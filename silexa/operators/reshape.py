"""Projection, reshaping, splitting and the SQL script operator."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..session import staged


def choose_columns(df: DataFrame, line: str, positions: list[int], separator: str = ",") -> DataFrame:
    """(value): the fields of a separated line at 1-based `positions`, joined by the separator again; missing ones are empty."""
    fields = F.split(F.col(line), f"\\Q{separator}\\E", -1)
    return df.select(F.array_join(F.array(*[F.coalesce(F.get(fields, F.lit(p - 1)), F.lit("")) for p in positions]), separator).alias("value"))


def sql_script(spark: SparkSession, script: str, inputs: dict[str, DataFrame | str], outputs: list[str]) -> dict[str, DataFrame]:
    """Run `;`-separated statements over named inputs (tables, or paths of JSON files) and return the named outputs.

    The whole SQL surface of Spark is there. A `;` inside quotes or comments doesn't end a statement. `CREATE TABLE` goes to a
    database of its own, dropped afterwards with what it holds, so outputs should be views (`CREATE TEMP VIEW name AS ...`); input
    and output views are temporary.
    """
    previous = spark.catalog.currentDatabase()
    scratch = f"silexa_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {scratch}")
    spark.sql(f"USE {scratch}")
    try:
        for name, source in inputs.items():
            (spark.read.json(source) if isinstance(source, str) else source).createOrReplaceTempView(name)
        for statement in split_statements(script):
            spark.sql(statement)
        return {name: spark.table(name) for name in outputs}
    finally:
        spark.sql(f"USE {previous}")
        spark.sql(f"DROP DATABASE {scratch} CASCADE")


def split_statements(script: str) -> list[str]:
    """The statements of a script, split at `;` outside of quotes and comments."""
    out, start, i, quote = [], 0, 0, ""
    while i < len(script):
        c = script[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else len(script)
            continue
        elif script.startswith("/*", i):
            end = script.find("*/", i)
            i = len(script) if end < 0 else end + 2
            continue
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
        i += 1
    out.append(script[start:])
    bare = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
    return [s.strip() for s in out if bare.sub("", s).strip()]


def transpose(df: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """Rows named by `index` become columns, `columns` become rows named in a column `name`. The index values must be few."""
    long = df.select(F.col(index).alias("__i"), F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    return long.groupBy("name").pivot("__i").agg(F.first("v"))


def restore_names(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """Columns `<c><suffix>` take the place and name of the columns `c`."""
    return df.select(*[F.col(f"{c}{suffix}").alias(c) if c in columns else F.col(c) for c in df.columns if not (c.endswith(suffix) and c[: -len(suffix)] in columns)])


def row_ids(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """`df` with consecutive ids from 0 in `order`: rows are range-partitioned, counted per partition and numbered inside it."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = staged(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ids")
    counts = {x[0]: x[1] for x in r.groupBy("__p").count().collect()}  # a row per partition
    start, at = {}, 0
    for p in sorted(counts):
        start[p] = at
        at += counts[p]
    first = F.element_at(F.create_map(*[F.lit(x) for kv in (start or {0: 0}).items() for x in kv]), F.col("__p"))
    n = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return r.withColumn(name, (n + first).cast("bigint")).drop("__p")


def row_normalize(df: DataFrame, value: str, key: str | None = None, label: str | None = None, separator: str = "\t") -> DataFrame:
    """(line): `id<sep>label<sep>value`; a missing id column gives consecutive ids from 0 in the rows' order, a missing label column NaN."""
    if key is None:
        df, key = row_ids(df.withColumn("__at", F.monotonically_increasing_id()), ["__at"], "__id"), "__id"
    y = F.col(label).cast("string") if label else F.lit("NaN")
    return df.select(F.concat_ws(separator, F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(y, F.lit("NaN")), F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("line"))


def random_split(df: DataFrame, ratio: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two random parts of `df`, the first of about `ratio`."""
    a, b = df.randomSplit([ratio, 1 - ratio], seed)
    return a, b


def hash_split(df: DataFrame, key: str, ratio: float = 0.5, buckets: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Two parts by a digest of the key: the same row falls on the same side in every run and engine, and equal keys together; rows of a
    null key are in the second."""
    side = F.floor(uniform(F.col(key).cast("string")) * buckets) < F.lit(round(ratio * buckets))
    return df.filter(side), df.filter(~side | F.col(key).isNull())


def add_column(df: DataFrame, values: list, name: str, kind: str) -> DataFrame:
    """`df` with a column of the given values, one for each row in the rows' order; rows beyond the values get null."""
    numbered = row_ids(df.withColumn("__at", F.monotonically_increasing_id()), ["__at"], "__id").drop("__at")
    column = df.sparkSession.createDataFrame(list(enumerate(values)), f"__id bigint, `{name}` {kind}")
    return numbered.join(column, "__id", "left").drop("__id")


def sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A random sample without replacement."""
    return df.sample(False, fraction, seed)


def shift_labels(df: DataFrame, label: str) -> DataFrame:
    """Class labels from 0: with more than two distinct labels each is lowered by one, else negative ones become 0."""
    n = df.agg(F.count_distinct(label).alias("__n"))
    y = F.col(label).cast("double")
    shifted = F.when(F.col("__n") > 2, y - 1).when(y < 0, 0.0).otherwise(y)
    return df.crossJoin(F.broadcast(n)).withColumn(label, shifted).drop("__n")
