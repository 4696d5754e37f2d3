"""Association rules: Apriori by joins, FP-growth and PrefixSpan by the built-in miners."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth, FPGrowthModel, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, staged


def baskets(items: str | Column, separator: str = " ") -> Column:
    """array<string>: the distinct non-empty items of a separated string."""
    col = F.col(items) if isinstance(items, str) else items
    return F.array_distinct(F.filter(F.split(F.trim(col), separator), lambda x: x != ""))


def apriori(df: DataFrame, basket: str, item: str, min_support: float = 0.7, max_size: int | None = None) -> DataFrame:
    """(items, size, count, support): frequent itemsets of (basket, item) rows; `items` joined by commas in ascending order.

    Level by level: each frequent set of a basket is extended by the basket's greater frequent items, so that only sets whose
    prefix is frequent are built; supports are counted with partial aggregation, and rows of infrequent sets are dropped by
    a semi-join before the next level. Each level's sets are written once: counting and extending them read that table.
    """
    pairs = df.select(F.col(basket).alias("b"), F.col(item).cast("string").alias("i")).filter(F.col("b").isNotNull() & F.col("i").isNotNull()).distinct()
    n = pairs.agg(F.count_distinct("b")).first()[0]
    least = F.lit(min_support * n - 1e-9)

    def frequent(rows: DataFrame, k: int) -> DataFrame:
        return cut(rows.groupBy("s").agg(F.count("*").alias("count")).filter(F.col("count") >= least).withColumn("size", F.lit(k)))

    rows = pairs.select("b", F.array("i").alias("s"))
    found = [frequent(rows, 1)]
    keep = pairs.join(found[0].select(F.get("s", F.lit(0)).alias("i")), "i", "left_semi")
    keep = cut(keep.select("b", "i"))
    rows = keep.select("b", F.array("i").alias("s"))
    size = 1
    while not found[-1].isEmpty() and (max_size is None or size < max_size):
        size += 1
        rows = staged(rows.join(keep, "b").filter(F.col("i") > F.element_at("s", -1)).select("b", F.concat("s", F.array("i")).alias("s")), "level")
        level = frequent(rows, size)
        found.append(level)
        rows = rows.join(level.select("s"), "s", "left_semi")
    every = reduce(DataFrame.unionByName, found)
    return every.select(F.array_join("s", ",").alias("items"), "size", "count", (F.col("count") / F.lit(float(max(n, 1)))).alias("support"))


def rules_of(itemsets: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """(antecedent, consequent, confidence, lift, support) with single consequents, from `apriori`'s itemsets."""
    big = itemsets.filter("size > 1").select("count", "support", F.split("items", ",").alias("s"))
    r = big.select("count", "support", "s", F.explode("s").alias("consequent"))
    r = r.withColumn("antecedent", F.array_join(F.array_remove("s", F.col("consequent")), ","))
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("count").alias("ca"))
    c = itemsets.filter("size = 1").select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
    r = r.join(a, "antecedent").join(c, "consequent").withColumn("confidence", F.col("count") / F.col("ca"))
    return r.filter(F.col("confidence") >= min_confidence).select("antecedent", "consequent", "confidence", (F.col("confidence") / F.col("sc")).alias("lift"), "support")


def fp_growth(df: DataFrame, items: str, min_support: float = 0.2, min_confidence: float = 0.6, prediction: str = "prediction") -> FPGrowthModel:
    """A frequent-pattern model of an array column of distinct items."""
    return FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence, predictionCol=prediction).fit(df)


def fp_predict(model: FPGrowthModel, df: DataFrame, separator: str = " ") -> DataFrame:
    """`df` with the items that the rules predict; array columns joined by blanks, ready for a CSV sink."""
    out = model.transform(df)
    arrays = [c for c, t in out.dtypes if t.startswith("array")]
    return out.withColumns({c: F.array_join(F.array_sort(c), separator) for c in arrays})


def prefix_span(df: DataFrame, sequence: str, min_support: float = 0.1, max_length: int = 10) -> DataFrame:
    """(sequence, freq): frequent sequential patterns of a column of arrays of itemsets."""
    return PrefixSpan(minSupport=min_support, maxPatternLength=max_length, sequenceCol=sequence).findFrequentSequentialPatterns(df)
