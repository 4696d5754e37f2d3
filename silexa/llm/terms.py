"""Terms of records: how often each occurs (problem 5) and how distinctive it is of a record (problem 2)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_words(words: str | Column, numeric: bool = False) -> Column:
    """The words of a record: trimmed, lower-cased, without empty ones; with `numeric`, without negative numbers.

    Null words are dropped; a null array stays null.
    """
    col = F.col(words) if isinstance(words, str) else words
    if numeric:
        return F.transform(F.filter(col, lambda x: x >= 0), lambda x: x.cast("string"))
    return F.filter(F.transform(col, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def one_per_record(df: DataFrame, key: str, words: Column, order: str | None) -> DataFrame:
    """(key, words): the latest row of every record (by `order`, ties by content). Rows without a key are dropped."""
    s = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("rec"), words.alias("w"), (F.col(order) if order else F.lit(0)).alias("o"))
    return s.groupBy("rec").agg(F.max_by("w", F.struct("o", F.xxhash64("w"))).alias("w")).filter(F.size("w") > 0)


def record_terms(records: DataFrame) -> DataFrame:
    """(rec, term, tf) from (rec, w), counted inside each row, so that no shuffle is needed.

    The sorted array is cut into runs; all steps are linear in the record's length.
    """
    s = records.select("rec", F.sort_array("w").alias("w"))
    s = s.withColumn("starts", F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 OR get(w, i) != get(w, i - 1))"))
    return s.select("rec", F.expr("inline(transform(starts, (p, k) -> struct(get(w, p) AS term, coalesce(get(starts, k + 1), size(w)) - p AS tf)))"))


def term_frequencies(df: DataFrame, key: str, words: Column, order: str | None = None, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """Occurrences and record count of every distinct term, with a mark on those too rare or too common.

    Per-record counts are made inside each row and combined by hash before the one shuffle on the term, so a term
    that occurs in every record costs one row per map task. Returns (term, occurrences, records, n_records, mark);
    `mark` is `rare` (records < `min_records`), `common` (records >= `max_share` * n_records; rare wins) or null.

    Null keys are dropped, records with null or empty word arrays don't count, repeated rows of a record count once
    (the latest by `order`); other columns are ignored. An empty table gives an empty result.
    """
    records = one_per_record(df, key, words, order)
    n = records.agg(F.count("*").alias("n_records"))
    counts = record_terms(records).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") >= F.col("n_records") * max_share, "common")
    return counts.crossJoin(F.broadcast(n)).withColumn("mark", mark)  # n is a single row


def _fit(hist_tf: list[np.ndarray], hist_n: list[np.ndarray], df: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-Poisson mixtures by expectation-maximisation, one per row, on padded frequency histograms."""
    width = max(len(x) for x in hist_tf) + 1
    x, c = np.zeros((len(df), width)), np.zeros((len(df), width))
    for i, (tf, cnt) in enumerate(zip(hist_tf, hist_n)):
        x[i, 1 : len(tf) + 1], c[i, 1 : len(tf) + 1] = tf, cnt
    c[:, 0] = n - df  # records without the term
    total = np.maximum(c.sum(1), 1.0)
    mean = (c * x).sum(1) / total
    above = (c * x).sum(1) / np.maximum(df, 1)
    low, high, share = mean * 0.25 + 1e-9, np.maximum(above, mean * 1.5) + 1e-6, np.clip(df / total, 1e-9, 0.5)
    for _ in range(rounds):
        logit = np.log(share / (1 - share))[:, None] + x * np.log(high / low)[:, None] - (high - low)[:, None]
        elite = c / (1 + np.exp(-np.clip(logit, -700, 700)))
        e = elite.sum(1)
        share = np.clip(e / total, 1e-12, 1 - 1e-12)
        high = np.maximum((elite * x).sum(1) / np.maximum(e, 1e-12), 1e-9)
        low = np.maximum(((c - elite) * x).sum(1) / np.maximum(total - e, 1e-12), 1e-9)
        low, high, share = np.minimum(low, high), np.maximum(low, high), np.where(low > high, 1 - share, share)
    return share, low, high


def term_model(counted: DataFrame, n: DataFrame, rounds: int = 40) -> DataFrame:
    """Per term the record count and the fitted mixture: (term, df, n, share, low, high).

    A term's histogram holds one entry per distinct frequency, so it is small however common the term is.
    """
    hist = counted.groupBy("term", "tf").agg(F.count("*").alias("c")).groupBy("term").agg(F.collect_list(F.struct("tf", "c")).alias("h"), F.sum("c").alias("df"))
    hist = hist.crossJoin(F.broadcast(n))  # one row
    hist = hist.select("term", F.col("h.tf").alias("tf"), F.col("h.c").alias("c"), "df", "n")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            df, n = (t[k].to_numpy().astype(float) for k in ("df", "n"))
            tf, c = ([np.asarray(v, float) for v in t[k].to_pandas()] for k in ("tf", "c"))
            # rows of like width are fitted together, so that one long histogram doesn't pad the others
            width = np.array([len(v) for v in tf])
            out = np.zeros((3, len(df)))
            cls = np.ceil(np.log2(width + 1)).astype(int)
            for k in np.unique(cls):
                at = np.flatnonzero(cls == k)
                out[:, at] = _fit([tf[i] for i in at], [c[i] for i in at], df[at], n[at], rounds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), *map(pa.array, out)], ["term", "df", "n", "share", "low", "high"])

    return hist.mapInArrow(fit, "term string, df bigint, n bigint, share double, low double, high double")


def distinctive_terms(df: DataFrame, key: str, words: Column, order: str | None = None, rounds: int = 40) -> DataFrame:
    """How characteristic each term is of each record, against the whole collection.

    Each term's frequencies over all records are taken as a mixture of two Poisson laws, fitted by
    expectation-maximisation on the term's frequency histogram; the score of an occurrence count is the posterior
    probability of the law with the higher mean (the elite component). Returns (rec, term, tf, df, n, score).

    Null keys are dropped, null or empty arrays give no rows, repeated rows of a record count once (the latest by
    `order`), other columns are ignored; an empty table gives an empty result.
    """
    records = one_per_record(df, key, words, order)
    n = records.agg(F.count("*").alias("n"))
    counted = record_terms(records)
    joined = counted.join(term_model(counted, n, rounds), "term")
    logit = F.log(F.col("share") / (1 - F.col("share"))) + F.col("tf") * F.log(F.col("high") / F.col("low")) - (F.col("high") - F.col("low"))
    return joined.select("rec", "term", "tf", "df", "n", (1 / (1 + F.exp(-logit))).alias("score"))
