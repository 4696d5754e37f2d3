import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from silexa.operators import ml, topics


@pytest.mark.parametrize("cells", [1 << 26, 0])
def test_planted_topics_are_found(spark, monkeypatch, cells):
    """Documents of two kinds of words, and some of both; with the counts in the tasks or joined to the tokens."""
    monkeypatch.setattr(topics, "CELLS", cells)
    rng = np.random.default_rng(1)
    docs = []
    for i in range(60):
        kinds = [i % 2] if i < 50 else [0, 1]
        docs.append((i, [f"{'ab'[rng.choice(kinds)]}{rng.integers(0, 12)}" for _ in range(40)]))
    d = spark.createDataFrame([*docs, (98, []), (99, None), (None, ["a1"])], "id bigint, words array<string>")
    m = topics.gibbs_fit(d, "id", "words", 2, 25, alpha=0.5)
    assert sum(m.totals) == 60 * 40 and m.words == 24
    top = {r["term"]: r["topic"] for r in m.terms().groupBy("term").agg(F.max_by("topic", "count").alias("topic")).collect()}
    assert len({t for w, t in top.items() if w[0] == "a"}) == 1 and len({t for w, t in top.items() if w[0] == "b"}) == 1 and len(set(top.values())) == 2
    shares = {r["id"]: r["topics"] for r in m.transform(d, "id", "words").collect()}
    assert set(shares) == set(range(60)) and all(max(shares[i]) > 0.9 for i in range(50)) and all(abs(sum(s) - 1) < 1e-9 for s in shares.values())
    assert topics.log_likelihood(m, d, "id", "words").first()["perplexity"] < 16
    again = topics.gibbs_fit(d.repartition(7), "id", "words", 2, 25, alpha=0.5)
    assert again.totals == m.totals  # draws depend on documents, not on partitions


def test_no_documents(spark):
    d = spark.createDataFrame([], "id bigint, words array<string>")
    m = topics.gibbs_fit(d, "id", "words", 3, 1)
    assert m.totals == [0, 0, 0] and m.terms().count() == 0 and m.transform(d, "id", "words").count() == 0


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_perplexity_is_that_of_the_learner(spark, optimizer):
    """Up to the random start of each document's topics; also beside empty documents and unknown words."""
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([*[([f"{'ab'[i % 2]}{rng.integers(0, 30)}" for _ in range(1 + i)],) for i in range(80)], ([],)], "words array<string>").repartition(3)
    m = ml.lda_fit(d, "words", 3, 5, optimizer=optimizer)
    d = d.union(spark.createDataFrame([(["new", "a1", "a1"],), (["new"],)], d.schema))
    counted = m.stages[0].transform(d)
    got = ml.perplexity(m, d).first()
    assert got["log_likelihood"] == pytest.approx(m.stages[1].logLikelihood(counted), rel=1e-4)
    assert got["log_perplexity"] == pytest.approx(m.stages[1].logPerplexity(counted), rel=1e-4) and got["perplexity"] == pytest.approx(math.exp(got["log_perplexity"]))
    assert ml.perplexity(m, d.repartition(7)).first()["log_likelihood"] == pytest.approx(got["log_likelihood"], rel=1e-12)  # starts don't depend on partitions
    none = ml.perplexity(m, d.filter("size(words) = 0")).first()
    assert none["log_likelihood"] == pytest.approx(m.stages[1].logLikelihood(counted.limit(0))) and math.isinf(none["perplexity"])


def test_perplexity_of_many_documents_and_words(spark):
    """Its time may not grow with documents x words: it takes about as long as the topics of the documents do."""
    d = spark.range(0, 10_000, 1, 4).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), F.col("id") * 10 + i)).alias("words"))
    m = ml.lda_fit(d, "words", 4, 1)
    times = []
    for run in (lambda: ml.lda_predict(m, d).agg(F.sum(F.get("topics", F.lit(0)))).first(), lambda: ml.perplexity(m, d).first()):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    assert len(m.stages[0].vocabulary) == 100_000 and times[1] < 10 * times[0]
