from itertools import combinations

import pytest
from pyspark.sql import functions as F

from silexa.functions import scalars
from silexa.operators import rules, text

BASKETS = ["1 3 4 5", "2 3 5", "1 2 3 4 5", "4 5", "1 3 5"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a", "c"]), (3, []), (4, None)], "id int, words array<string>")


def test_grams(spark):
    d = spark.createDataFrame([(["c", "a", "b"],), ([],)], "w array<string>")
    r = d.select(text.grams(F.col("w"), "bigram").alias("g"), text.grams(F.col("w"), "biterm", 2).alias("t")).collect()
    assert r[0]["g"] == ["c a", "a b"] and r[0]["t"] == ["a c", "a b"] and r[1]["g"] == [] and r[1]["t"] == []
    with pytest.raises(ValueError):
        text.grams(F.col("w"), "trigram")


def test_counts_and_index(docs):
    assert {r["term"]: r["count"] for r in text.term_counts(docs, "words").collect()} == {"a": 2, "b": 2, "c": 1}
    assert {r["term"]: r["count"] for r in text.term_counts(docs, "words", by_document=True).collect()} == {"a": 2, "b": 1, "c": 1}
    ix = text.index_fit(docs, "words")
    assert {r["term"]: r["id"] for r in ix.collect()} == {"a": 0, "b": 1, "c": 2}
    out = {r["id"]: r["ids"] for r in text.index_transform(docs, "id", "words", ix.filter("term <> 'c'")).collect()}
    assert out == {1: [1, 0, 1], 2: [0]}


def test_filter_words(docs, spark):
    bad = text.bad_words(docs, "words", spark.createDataFrame([("c",)], "w string"), 1, None, 1, 1, 10)
    assert {r["term"] for r in bad.collect()} == {"a", "c"}
    assert {r["id"]: r["words"] for r in text.filter_words(docs, "id", "words", bad).collect()} == {1: ["b", "b"]}


def test_feature_merge(spark):
    nan = float("nan")
    a = spark.createDataFrame([("x", nan, {"p": 1.0, "q": 2.0}), ("y", 5.0, {"p": 3.0})], "id string, label double, features map<string,double>")
    b = spark.createDataFrame([("x", 7.0, {"q": 9.0}), ("z", None, {"r": 1.0})], "id string, label double, features map<string,double>")
    out = {r["id"]: (r["label"], r["features"]) for r in text.feature_merge(a, b).collect()}
    assert out == {"x": (7.0, {"p": 1.0, "q": 9.0}), "y": (5.0, {"p": 3.0}), "z": (None, {"r": 1.0})}


def test_min_max(spark):
    d = spark.createDataFrame([(1, "f", 2.0), (2, "f", 4.0), (3, "g", 1.0)], "id int, feature string, value double")
    out = {(r["id"], r["feature"]): round(r["value"], 6) for r in text.min_max_transform(d, text.min_max_fit(d), "id").collect()}
    assert out == {(1, "f"): 0.0, (2, "f"): 1.0, (3, "g"): 0.0}


def test_apriori_on_the_known_baskets(spark):
    d = spark.createDataFrame(list(enumerate(BASKETS)), "b int, items string").select("b", F.explode(rules.baskets("items")).alias("i"))
    got = {r["items"]: r["count"] for r in rules.apriori(d, "b", "i", 0.4).collect()}
    sets = [set(b.split()) for b in BASKETS]
    want = {}
    for k in range(1, 6):
        for c in combinations("12345", k):
            n = sum(set(c) <= s for s in sets)
            if n >= 2:
                want[",".join(c)] = n
    assert got == want and got["5"] == 5 and got["3,5"] == 4


def test_rules_and_fp_growth(spark):
    d = spark.createDataFrame(list(enumerate(BASKETS)), "b int, items string").select("b", rules.baskets("items").alias("items"))
    m = rules.fp_growth(d, "items", 0.4, 0.6)
    assert {",".join(sorted(r["items"])): r["freq"] for r in m.freqItemsets.collect()}["3,5"] == 4
    sets = rules.apriori(d.select("b", F.explode("items").alias("i")), "b", "i", 0.4)
    mine = {(r["antecedent"], r["consequent"]): round(r["confidence"], 9) for r in rules.rules_of(sets, 0.6).collect()}
    theirs = {(",".join(sorted(r["antecedent"])), r["consequent"][0]): round(r["confidence"], 9) for r in m.associationRules.collect()}
    assert mine == theirs
    assert rules.fp_predict(m, d).schema["prediction"].dataType.simpleString() == "string"
    assert rules.apriori(d.limit(0).select("b", F.explode("items").alias("i")), "b", "i", 0.4).count() == 0


def test_scalars(spark):
    d = spark.createDataFrame([(0.0, "a:1,b:c:2,x", 1_700_000_000, "k")], "x double, p string, t bigint, k string")
    parts = scalars.time_parts("t")
    r = d.select(scalars.sigmoid("x").alias("s"), scalars.parse_pairs("p").alias("m"), parts["weekday"].alias("w"), scalars.parse_time(scalars.format_time("t")).alias("back"), scalars.parse_int("k").alias("i"), scalars.multinomial([1.0, 0.0, 0.0], "k").alias("z"), scalars.unescape(F.lit("a\\tb")).alias("u")).first()
    assert r["s"] == 0.5 and r["m"] == {"a": "1", "b:c": "2"} and r["w"] == 2 and r["back"] == 1_700_000_000 and r["i"] is None and r["z"] == 0 and r["u"] == "a\tb"
    with pytest.raises(ValueError):
        scalars.kernel("x", "other")


def test_draws_follow_their_weights(spark):
    d = spark.range(20_000).select(scalars.multinomial([1.0, 2.0, 1.0], "id").alias("m"), scalars.poisson(0.6, "id").alias("p"), scalars.bernoulli(0.3, "id").alias("b"))
    r = d.agg(F.avg((F.col("m") == 1).cast("double")), F.avg("p"), F.avg(F.col("b").cast("double"))).first()
    assert abs(r[0] - 0.5) < 0.02 and abs(r[1] - 0.6) < 0.03 and abs(r[2] - 0.3) < 0.02
