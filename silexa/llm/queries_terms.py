"""Queries of problems 2 and 5 and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import terms


def _sources(spark: SparkSession, d: str) -> list[tuple]:
    return [
        ("raw", table(spark, d, "raw_docs"), "rec_id", terms.clean_words("words"), "loaded_at"),
        ("idx", table(spark, d, "docs"), "rec_id", terms.clean_words("words", numeric=True), "loaded_at"),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that pass the exact bound of the statement in a record.

    Every scored row is a candidate: where a term's frequencies are very uneven, the model's elite law goes to the one
    extreme record, so a low score doesn't tell that a term is no case.
    """
    parts = []
    for src, df, key, words, order in _sources(spark, d):
        scored = terms.distinctive_terms(df, key, words, order)
        bound = F.col("tf") * F.log(F.col("n") / F.col("df")) / F.nullif(F.log(F.col("n")), F.lit(0.0)) >= 2.5
        parts.append(scored.filter(bound).select(F.lit(src).alias("src"), F.col("rec").alias("rec_id"), "term"))
    return parts[0].unionByName(parts[1])


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """How distinctive every term is of every record: the posterior probability of the elite component."""
    parts = [terms.distinctive_terms(df, key, words, order).select(F.lit(src).alias("src"), F.col("rec").alias("rec_id"), "term", "tf", F.round("score", 4).alias("score")) for src, df, key, words, order in _sources(spark, d)]
    return parts[0].unionByName(parts[1])


def p2_term_models(spark: SparkSession, d: str) -> DataFrame:
    """The mixture fitted to every term's frequencies."""
    parts = []
    for src, df, key, words, order in _sources(spark, d):
        records = terms.one_per_record(df, key, words, order)
        model = terms.term_model(terms.record_terms(records), records.agg(F.count("*").alias("n")))
        parts.append(model.select(F.lit(src).alias("src"), "term", "df", F.round("share", 5).alias("share"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high")))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    parts = []
    for src, df, key, words, order in _sources(spark, d):
        freq = terms.term_frequencies(df, key, words, order)
        parts.append(freq.filter(F.col("mark").isNotNull()).select(F.lit(src).alias("src"), "term", "mark"))
    return parts[0].unionByName(parts[1])


def p5_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and record count of every term of both tables."""
    parts = [terms.term_frequencies(df, key, words, order).select(F.lit(src).alias("src"), "term", "occurrences", "records") for src, df, key, words, order in _sources(spark, d)]
    return parts[0].unionByName(parts[1])


_CLEAN = """
WITH latest AS (
  SELECT 'raw' AS src, rec_id, list_filter(list_transform(words, lambda x: lower(trim(x))), lambda x: x <> '') AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) AS rn FROM raw_docs) WHERE rn = 1
  UNION ALL
  SELECT 'idx', rec_id, list_transform(list_filter(words, lambda x: x >= 0), lambda x: CAST(x AS VARCHAR))
  FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) AS rn FROM docs) WHERE rn = 1),
n AS (SELECT src, count(*) AS n FROM latest WHERE len(w) > 0 GROUP BY src),
tf AS (SELECT src, rec_id, term, count(*) AS tf FROM (SELECT src, rec_id, unnest(w) AS term FROM latest) GROUP BY ALL),
df AS (SELECT src, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL)
"""

def _em(rounds: int = 40) -> str:
    """The fit of `terms.term_model`, a table of states per round, and of the scores after the last."""
    start = """, h AS MATERIALIZED (SELECT src, term, tf::DOUBLE AS x, count(*)::DOUBLE AS c FROM tf GROUP BY ALL UNION ALL SELECT src, term, 0, (n - df)::DOUBLE FROM df JOIN n USING (src)),
m AS (SELECT src, term, greatest(sum(c), 1) AS total, sum(c * x) / greatest(sum(c), 1) AS mean, sum(c * x) / greatest(sum(c) FILTER (x > 0), 1) AS above, sum(c) FILTER (x > 0) AS d FROM h GROUP BY ALL),
s0 AS MATERIALIZED (SELECT src, term, total, greatest(1e-9, least(0.5, d / total)) AS share, mean * 0.25 + 1e-9 AS low, greatest(above, mean * 1.5) + 1e-6 AS high FROM m)"""
    step = """, e{k} AS (SELECT src, term, any_value(total) AS total, sum(p) AS e, sum(p * x) AS ex, sum((c - p) * x) AS rx FROM (SELECT src, term, total, x, c,
  c / (1 + exp(-greatest(-700, least(700, ln(share / (1 - share)) + x * ln(high / low) - (high - low))))) AS p FROM h JOIN s{j} USING (src, term)) GROUP BY ALL),
u{k} AS (SELECT src, term, total, greatest(1e-12, least(1 - 1e-12, e / total)) AS share, greatest(1e-9, rx / greatest(total - e, 1e-12)) AS low, greatest(1e-9, ex / greatest(e, 1e-12)) AS high FROM e{k}),
s{k} AS MATERIALIZED (SELECT src, term, total, CASE WHEN low > high THEN 1 - share ELSE share END AS share, least(low, high) AS low, greatest(low, high) AS high FROM u{k})"""
    return start + "".join(step.format(k=k, j=k - 1) for k in range(1, rounds + 1))


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores, "p2_term_models": p2_term_models, "p5_found": p5_found, "p5_term_frequencies": p5_term_frequencies}
SQL = {
    "p2_found": _CLEAN + "SELECT src, rec_id, term FROM tf JOIN df USING (src, term) JOIN n USING (src) WHERE tf * ln(n / df) / ln(n) >= 2.5",
    "p2_scores": _CLEAN + _em() + " SELECT src, rec_id, term, tf, round(1 / (1 + exp(-(ln(share / (1 - share)) + tf * ln(high / low) - (high - low)))), 4) AS score FROM tf JOIN s40 USING (src, term)",
    "p2_term_models": _CLEAN + _em() + " SELECT src, term, df, round(share, 5) AS share, round(low, 5) AS low, round(high, 5) AS high FROM s40 JOIN df USING (src, term)",
    "p5_found": _CLEAN + "SELECT src, term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df JOIN n USING (src) WHERE df <= 2 OR df >= 0.2 * n",
    "p5_term_frequencies": _CLEAN + "SELECT src, term, CAST(cf AS BIGINT) AS occurrences, df AS records FROM df",
}
