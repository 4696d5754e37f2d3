"""Text preprocessing: tokens, term counts, filters, indexes, TF-IDF, feature tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reshape import row_ids

#: Tokens of an English text: at least two letters, digits or hyphens.
TOKEN = r"([a-z0-9\-]{2,})"


def tokens(text: str | Column) -> Column:
    """array<string> of the tokens of a text; the segmenter used where a language has blanks."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN))


def clean_english(text: str | Column) -> Column:
    """The tokens joined by single blanks."""
    return F.array_join(tokens(text), " ")


def segment(df: DataFrame, text: str, segmenter: Callable[[str], Column] | None = None) -> DataFrame:
    """`df` with a column `words`. `segmenter` maps a column name to an array<string> expression, for languages without
    blanks (a pandas UDF around a dictionary segmenter, for instance); the default splits into `tokens`."""
    return df.withColumn("words", (segmenter or tokens)(text))


def grams(words: Column, kind: str = "unigram", window: int = 10) -> Column:
    """The terms of a word array: `unigram`, `bigram` (adjacent, joined by a blank) or `biterm`.

    A biterm is an unordered pair of words less than `window` positions apart, in alphabetical order.
    """
    if kind == "unigram":
        return words
    if kind == "bigram":
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(words, i + 1)))
    if kind == "biterm":
        pair = lambda a, b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
        return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, window - 1), lambda y: pair(x, y))))
    raise ValueError(f"unknown term kind {kind!r}")


def term_counts(df: DataFrame, words: str, kind: str = "unigram", by_document: bool = False, window: int = 10) -> DataFrame:
    """(term, count): occurrences of every term, or with `by_document` the number of rows that hold it."""
    terms = grams(F.col(words), kind, window)
    return df.select(F.explode(F.array_distinct(terms) if by_document else terms).alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def default_stop_words(spark: SparkSession, language: str = "english") -> DataFrame:
    """(word): the built-in list of a language."""
    from pyspark.ml.feature import StopWordsRemover

    return spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords(language)], "word string")


def bad_words(df: DataFrame, words: str, stop_words: DataFrame | None = None, min_freq: int = 5, max_freq: int | None = None, top_n: int = 100, min_len: int = 2, max_len: int = 10) -> DataFrame:
    """(term) of stop words, the `top_n` most frequent ones (ties by term), and those of a frequency or length out of bounds."""
    c = term_counts(df, words)
    out = (F.col("count") < min_freq) | (F.length("term") < min_len) | (F.length("term") > max_len)
    if max_freq is not None:
        out = out | (F.col("count") > max_freq)
    bad = c.filter(out).select("term")
    if top_n:
        bad = bad.union(c.orderBy(F.desc("count"), "term").limit(top_n).select("term"))
    if stop_words is not None:
        bad = bad.union(stop_words.select(F.col(stop_words.columns[0]).alias("term")))
    return bad.distinct()


def filter_words(df: DataFrame, key: str, words: str, bad: DataFrame) -> DataFrame:
    """(key, words) without the words of `bad`; order kept, rows left empty dropped. `key` identifies a row."""
    x = df.select(F.col(key).alias("__key"), F.posexplode(words).alias("at", "term")).join(bad, "term", "left_anti")
    x = x.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("w"))
    return x.select(F.col("__key").alias(key), F.transform("w", lambda s: s["term"]).alias(words))


def index_fit(df: DataFrame, items: str) -> DataFrame:
    """(term, id): ids from 0 in alphabetical order, of the distinct items of an array column.

    Terms are range-partitioned, and each range starts from the sizes of those before it, however alike the terms begin.
    """
    terms = df.select(F.explode(items).alias("term")).filter(F.col("term").isNotNull()).distinct()
    return row_ids(terms, ["term"])


def index_transform(df: DataFrame, key: str, words: str, index: DataFrame) -> DataFrame:
    """(key, ids): words replaced by their ids in order; unknown words dropped."""
    x = df.select(F.col(key).alias("__key"), F.posexplode(words).alias("at", "term")).join(index.select("term", "id"), "term")
    x = x.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("w"))
    return x.select(F.col("__key").alias(key), F.transform("w", lambda s: s["id"]).alias("ids"))


def idf_fit(df: DataFrame, words: str) -> DataFrame:
    """(term, idf): ln((D + 1) / (df + 1)), D the number of rows."""
    n = df.agg(F.count("*").alias("n"))
    return term_counts(df, words, by_document=True).crossJoin(F.broadcast(n)).select("term", F.log((F.col("n") + 1) / (F.col("count") + 1)).alias("idf"))


def tf_idf(df: DataFrame, key: str, words: str, idf: DataFrame) -> DataFrame:
    """(key, term, weight): raw frequency times idf; terms without idf dropped."""
    tf = df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def explode_features(df: DataFrame, key: str, features: str) -> DataFrame:
    """(key, feature, value) of a map column."""
    return df.select(key, F.explode(features).alias("feature", "value"))


def feature_index_transform(df: DataFrame, key: str, features: str, index: DataFrame) -> DataFrame:
    """(key, ids, values): a feature map by ids in ascending order; unknown features dropped."""
    x = explode_features(df.withColumnRenamed(key, "__key"), "__key", features).join(index.select(F.col("term").alias("feature"), F.col("id").alias("fid")), "feature")
    x = x.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("w"))
    return x.select(F.col("__key").alias(key), F.transform("w", lambda s: s["fid"]).alias("ids"), F.transform("w", lambda s: s["value"]).alias("values"))


def feature_merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """(id, label, features) of tables of that shape, joined on id: the leftmost label that is there wins, the rightmost
    value of a feature wins. One shuffle on the id for all tables. Repeated ids of a table are merged alike.
    """
    tagged = [t.select("id", F.lit(i).alias("t"), "label", "features") for i, t in enumerate((first, *others))]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    label = F.when(F.col("label").isNotNull() & ~F.isnan("label"), F.col("label"))
    g = both.groupBy("id").agg(F.min_by(label, F.when(label.isNotNull(), F.col("t"))).alias("label"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("t", F.map_entries("features").alias("f")))), lambda s: s["f"])).alias("e"))
    # of equal features the last entry counts: entries sorted by name and place are compared with the next one only
    placed = F.array_sort(F.transform("e", lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value"))))
    g = g.select("id", "label", placed.alias("e"))
    last = F.filter("e", lambda x, i: ~F.coalesce(F.get("e", i + 1)["key"] == x["key"], F.lit(False)))
    return g.select("id", "label", F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"]))).alias("features"))


def min_max_fit(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, min, max) over the entries that are present."""
    return df.groupBy(F.col(feature).alias("feature")).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def min_max_transform(df: DataFrame, params: DataFrame, key: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(key, feature, value): (v - min) / (max - min + 1e-10); features without parameters dropped."""
    x = df.select(key, F.col(feature).alias("feature"), F.col(value).alias("v")).join(params, "feature")
    return x.select(key, "feature", ((F.col("v") - F.col("min")) / (F.col("max") - F.col("min") + 1e-10)).alias("value"))
