"""Problems 2 and 5."""
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from silexa.llm import queries_terms, terms

SCHEMA = "rec_id string, words array<string>, loaded_at int, term string, n int"


def rows(spark):
    data = [
        ("a", [" Red ", "red", "BLUE", "", None], 1, "x", 1),
        ("a", [" Red ", "red", "BLUE", "", None], 2, "x", 1),  # a resend
        ("b", ["red", "green"], 1, None, None),
        ("c", None, 1, "x", 2),
        ("d", [], 1, "x", 2),
        ("e", ["   "], 1, "x", 2),
        (None, ["red"], 1, "x", 2),
        ("f", ["long"] * 20_000, 1, "x", 2),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_clean_words(spark):
    df = spark.createDataFrame([([" A\t", "", None, "é "], [3, -1, None, 0])], "s array<string>, i array<int>")
    r = df.select(terms.clean_words("s").alias("s"), terms.clean_words("i", numeric=True).alias("i")).first()
    assert r["s"] == ["a", "é"] and r["i"] == ["3", "0"]


def test_term_frequencies(spark):
    out = {r["term"]: r for r in terms.term_frequencies(rows(spark), "rec_id", terms.clean_words("words"), "loaded_at", min_records=2, max_share=0.6).collect()}
    assert {k: (r["occurrences"], r["records"]) for k, r in out.items()} == {"red": (3, 2), "blue": (1, 1), "green": (1, 1), "long": (20_000, 1)}
    assert all(r["n_records"] == 3 for r in out.values())
    assert (out["red"]["mark"], out["blue"]["mark"]) == ("common", "rare")


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert terms.term_frequencies(empty, "rec_id", terms.clean_words("words"), "loaded_at").count() == 0
    assert terms.distinctive_terms(empty, "rec_id", terms.clean_words("words"), "loaded_at").count() == 0


def test_record_terms_against_counter(spark):
    rng = np.random.default_rng(3)
    docs = {f"r{i}": [f"w{k}" for k in rng.zipf(1.5, rng.integers(1, 60)) if k < 50] for i in range(200)}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "rec string, w array<string>").filter(F.size("w") > 0)
    got = {(r["rec"], r["term"]): r["tf"] for r in terms.record_terms(df).collect()}
    assert got == {(k, t): n for k, v in docs.items() for t, n in Counter(v).items()}


def test_two_poisson_recovers_a_mixture():
    rng = np.random.default_rng(0)
    x = np.where(rng.random(20_000) < 0.2, rng.poisson(6.0, 20_000), rng.poisson(0.3, 20_000))
    tf, c = np.unique(x[x > 0], return_counts=True)
    share, low, high = terms._fit([tf.astype(float)], [c.astype(float)], np.array([(x > 0).sum()], float), np.array([len(x)], float), 200)
    assert abs(share[0] - 0.2) < 0.02 and abs(low[0] - 0.3) < 0.03 and abs(high[0] - 6.0) < 0.2


def test_distinctive_scores(spark):
    data = [(f"r{i}", ["the", "of"] + (["rare"] * 5 if i == 7 else [])) for i in range(60)]
    df = spark.createDataFrame([(k, v, 0, "x", 1) for k, v in data], SCHEMA)
    out = terms.distinctive_terms(df, "rec_id", terms.clean_words("words"), "loaded_at").collect()
    assert len(out) == 121
    rare = next(r for r in out if r["term"] == "rare")
    assert rare["score"] > 0.99 and (rare["tf"], rare["df"], rare["n"]) == (5, 1, 60)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert 5 * math.log(60 / 1) / math.log(60) >= 2.5


def test_score_grows_with_the_count(spark):
    data = [(f"r{i}", ["w"] * (1 if i < 30 else 2 if i < 35 else 9), 0, "", 0) for i in range(40)]
    out = {r["tf"]: r["score"] for r in terms.distinctive_terms(spark.createDataFrame(data, SCHEMA), "rec_id", terms.clean_words("words"), "loaded_at").collect()}
    assert out[1] <= out[2] <= out[9] and out[9] > 0.9


def test_a_single_record(spark):
    df = spark.createDataFrame([("a", ["x", "x"], 0, "", 0)], SCHEMA)
    r = terms.distinctive_terms(df, "rec_id", terms.clean_words("words"), "loaded_at").collect()
    assert len(r) == 1 and not math.isnan(r[0]["score"])


def test_one_extreme_record_hides_no_other(spark, tmp_path):
    """A term with tf 3 and 60: the model takes only the 60 for elite, the exact bound holds for both."""
    words = [["w"] * 3, ["w"] * 60, *[["filler"]] * 5_998]
    spark.createDataFrame([(f"r{i}", w, 0) for i, w in enumerate(words)], "rec_id string, words array<string>, loaded_at int").write.parquet(str(tmp_path / "raw_docs.parquet"))
    spark.createDataFrame([(f"r{i}", [7] * len(w) if w[0] == "w" else [1], 0) for i, w in enumerate(words)], "rec_id string, words array<int>, loaded_at int").write.parquet(str(tmp_path / "docs.parquet"))
    assert 3 * math.log(6_000 / 2) / math.log(6_000) >= 2.5
    got = {(r["src"], r["rec_id"], r["term"]) for r in queries_terms.p2_found(spark, str(tmp_path)).collect()}
    assert got == {(src, rec, term) for src, term in (("raw", "w"), ("idx", "7")) for rec in ("r0", "r1")}
