"""Operators that delegate to the built-in learners: PCA, feature selection, boosted trees, factors, topics, word vectors."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import PCA, ChiSqSelector, CountVectorizer, VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip")


def pca_fit(df: DataFrame, features: list[str], k: int = 3) -> tuple[PipelineModel, DataFrame]:
    """The fitted pipeline and (row, explained, sum_explained), rows from 0. Rows with null or NaN features are skipped."""
    model = Pipeline(stages=[_assembled(features), PCA(k=k, inputCol="features", outputCol="pca")]).fit(df)
    values, rows, total = [float(v) for v in model.stages[-1].explainedVariance], [], 0.0
    for i, v in enumerate(values):  # k numbers
        total += v
        rows.append((i, v, total))
    return model, df.sparkSession.createDataFrame(rows, "row int, explained double, sum_explained double")


def pca_transform(model: PipelineModel, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(keep ..., col1 .. colk)"""
    k = model.stages[-1].getK()
    x = model.transform(df).select(*keep, vector_to_array("pca").alias("x"))
    return x.select(*keep, *[F.get("x", F.lit(i)).alias(f"col{i + 1}") for i in range(k)])


def chi_square_select(df: DataFrame, features: str, label: str, number: int, bin_width: float = 16.0) -> DataFrame:
    """(label, selected array<double>): the features (array column) most dependent on the label, binned as floor(x / width)."""
    binned = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(features, lambda x: F.floor(x / bin_width).cast("double"))).alias("v"))
    model = ChiSqSelector(numTopFeatures=number, featuresCol="v", labelCol="label", outputCol="selected").fit(binned)
    return model.transform(binned).select("label", vector_to_array("selected").alias("selected"))


def gbt_regressor(df: DataFrame, features: list[str], label: str, max_iter: int = 20, max_depth: int = 5, impurity: str = "variance", seed: int = 42) -> PipelineModel:
    """Gradient-boosted regression trees. `impurity` "gini" is accepted and means "variance": regression knows no other."""
    if impurity not in ("variance", "gini"):
        raise ValueError(f"unknown impurity {impurity!r}")
    return Pipeline(stages=[_assembled(features), GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed)]).fit(df)


def gbt_predict(model: PipelineModel, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return model.transform(df).drop("features").withColumnRenamed("prediction", prediction)


def linear_regression(df: DataFrame, features: list[str], label: str, reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Least squares by the normal equations (iterative beyond 4096 features)."""
    return Pipeline(stages=[_assembled(features), LinearRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter)]).fit(df)


def linear_coefficients(model: PipelineModel) -> DataFrame:
    """(feature, coefficient), the intercept as feature "(intercept)"."""
    lr, names = model.stages[-1], model.stages[0].getInputCols()
    from pyspark.sql import SparkSession

    rows = [*zip(names, map(float, lr.coefficients)), ("(intercept)", float(lr.intercept))]
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double")


def als(rates: DataFrame, k: int = 10, reg: float = 0.1, max_iter: int = 10, nonnegative: bool = True, seed: int = 42) -> ALSModel:
    """Non-negative factors of (user, item, rating) by alternating least squares; unknown ids are dropped when predicting."""
    return ALS(rank=k, regParam=reg, maxIter=max_iter, nonnegative=nonnegative, userCol="user", itemCol="item", ratingCol="rating", seed=seed, coldStartStrategy="drop").fit(rates)


def lda_fit(df: DataFrame, words: str, k: int = 10, max_iter: int = 20, alpha: float | None = None, beta: float | None = None, optimizer: str = "online", vocabulary: int | None = None, seed: int = 42) -> PipelineModel:
    """Topics of a column of word arrays, over all its words, or the `vocabulary` most frequent ones if a number is given. The priors default to 50 / k and 0.01 for `em` (raised above 1 as it needs), else to the learner's."""
    lda = LDA(k=k, maxIter=max_iter, optimizer=optimizer, seed=seed, featuresCol="counts", topicDistributionCol="topics")
    if alpha is not None or optimizer == "em":
        lda = lda.setDocConcentration([max(alpha if alpha is not None else 50.0 / k + 1, 1.01 if optimizer == "em" else 0.0)])
    if beta is not None or optimizer == "em":
        lda = lda.setTopicConcentration(max(beta if beta is not None else 1.01, 1.01 if optimizer == "em" else 0.0))
    return Pipeline(stages=[CountVectorizer(inputCol=words, outputCol="counts", vocabSize=vocabulary or 2**31 - 1), lda]).fit(df)


def lda_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with `topics`, each row's distribution over topics."""
    return model.transform(df).withColumn("topics", vector_to_array("topics")).drop("counts")


def lda_topics(model: PipelineModel, terms: int = 10) -> DataFrame:
    """(topic, terms, weights)"""
    top = model.stages[1].describeTopics(terms)
    vocabulary = model.stages[0].vocabulary  # the model holds it; only the words that topics name are sent on
    named = {i: vocabulary[i] for r in top.select("termIndices").collect() for i in r[0]}  # topics x terms
    words = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return top.select("topic", F.transform("termIndices", lambda i: F.element_at(words, i)).alias("terms"), F.col("termWeights").alias("weights"))


def _gamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digamma and the log-gamma function for x > 0: Stirling's series at x + 10, and back by the recurrence."""
    y = x + 10.0
    z = 1 / (y * y)
    digamma = np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    log_gamma = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    for i in range(10):
        digamma, log_gamma = digamma - 1 / (x + i), log_gamma - np.log(x + i)
    return digamma, log_gamma


def _document_bounds(held, alpha: np.ndarray):
    """(bound, tokens) of each batch of (topics, i, c): the documents' part of the variational bound. `held` has a row a topic."""
    prior = alpha.sum()
    constant = _gamma(prior)[1] - _gamma(alpha)[1].sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_words = held.value
        for b in batches:
            i, c = (b.column(x).flatten().to_numpy() for x in ("i", "c"))
            doc = np.repeat(np.arange(b.num_rows), b.column("i").value_lengths().to_numpy())
            n = np.bincount(doc, c, b.num_rows)
            # every token gives one to the sum of a document's parameters, the priors the rest
            gamma = b.column("topics").flatten().to_numpy().reshape(-1, len(alpha)) * (prior + n)[:, None]
            gamma[n == 0] = alpha  # a document without known words keeps the priors, and its bound is 0
            digamma, log_gamma = _gamma(gamma)
            log_topics = digamma - _gamma(prior + n)[0][:, None]
            p = np.full(len(i), -np.inf)
            for t, log_word in enumerate(log_words):
                p = np.logaddexp(p, log_topics[doc, t] + log_word[i])
            bound = (c * p).sum() + ((alpha - gamma) * log_topics + log_gamma).sum() + (constant - _gamma(prior + n)[1]).sum()
            yield pa.RecordBatch.from_arrays([pa.array([bound]), pa.array([c.sum()])], ["bound", "tokens"])

    return run


def perplexity(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(log_likelihood, log_perplexity, perplexity) of a corpus under a topic model, by the variational lower bound.

    The learner's own bound takes the exponentials of the whole table of words and topics again for every document, so its time grows
    with documents x words. Here its inference gives the documents' topics with that table made once, and the bound is summed from them.
    """
    lda: LDAModel = model.stages[1]
    counted = model.stages[0].transform(df).select(lda.getFeaturesCol())
    of_topics = lda.logLikelihood(counted.limit(0))  # without documents, only the topics' part is left
    topics = lda.topicsMatrix().toArray().T
    held = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(_gamma(topics)[0] - _gamma(topics.sum(1))[0][:, None]))
    v = F.unwrap_udt(lda.getFeaturesCol())
    docs = lda.transform(counted).select(vector_to_array(lda.getTopicDistributionCol()).alias("topics"), v["indices"].alias("i"), v["values"].alias("c"))
    s = docs.mapInArrow(_document_bounds(held, lda.estimatedDocConcentration().toArray()), "bound double, tokens double").agg(F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens")).first()
    held.unpersist()
    total = of_topics + (s["bound"] or 0.0)
    with np.errstate(all="ignore"):  # no tokens, or an infinite perplexity
        log_p = -np.float64(total) / (s["tokens"] or 0.0)
        out = float(log_p), float(np.exp(log_p))
    return df.sparkSession.createDataFrame([(total, *out)], "log_likelihood double, log_perplexity double, perplexity double")


def word2vec_fit(df: DataFrame, words: str, k: int = 100, learn_rate: float = 0.025, window: int = 3, max_iter: int = 5, min_count: int = 5, partitions: int | None = None, seed: int = 42) -> Word2VecModel:
    """Skip-gram vectors; by default a partition for every 10,000 texts, at most one a core, as the vectors of partitions are averaged each round."""
    if partitions is None:
        partitions = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // 10_000)))
    return Word2Vec(vectorSize=k, stepSize=learn_rate, windowSize=window, maxIter=max_iter, minCount=min_count, numPartitions=partitions, inputCol=words, outputCol="vector", seed=seed).fit(df)


def word_similarity(model: Word2VecModel, a: str, b: str) -> DataFrame:
    """(similarity): the cosine of two words' vectors; no row if one is unknown."""
    v = model.getVectors().select("word", vector_to_array("vector").alias("v"))
    x, y = v.filter(F.col("word") == a).select(F.col("v").alias("x")), v.filter(F.col("word") == b).select(F.col("v").alias("y"))
    from ..functions.vectors import cosine

    return x.crossJoin(F.broadcast(y)).select(cosine("x", "y").alias("similarity"))  # one row each


def synonyms(model: Word2VecModel, word: str, k: int = 10) -> DataFrame:
    return model.findSynonyms(word, k)
