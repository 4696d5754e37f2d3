"""Topic models by Gibbs sampling: all tokens of a round are drawn at once from the counts of the round before."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, staged
from .text import index_fit, index_transform

#: Counts (words x topics) that tasks may hold, 4 bytes each; beyond, each token's counts are joined to it.
CELLS = 1 << 26


def _counts(state: DataFrame, k: int) -> DataFrame:
    """(w, n array<int>): how often each word stands in each topic."""
    tokens = state.select(F.inline(F.arrays_zip(F.col("w").alias("w"), F.col("z").alias("z"))))
    return tokens.groupBy("w").agg(F.array(*[F.count_if(F.col("z") == t).cast("int") for t in range(k)]).alias("n"))


def _with_counts(state: DataFrame, counts: DataFrame, words: int, k: int) -> tuple[DataFrame, np.ndarray | None]:
    """The documents, and the counts as a matrix if it is small enough; else each document with its tokens' counts, flat."""
    if words * k <= CELLS:
        matrix = np.zeros((words, k), np.int32)
        for w, n in counts.toLocalIterator():
            matrix[w] = n
        return state.withColumn("n", F.lit(None).cast("array<int>")), matrix
    long = state.select("key", F.posexplode(F.arrays_zip(F.col("w").alias("w"), F.col("z").alias("z"))).alias("at", "x")).select("key", "at", "x.w", "x.z").join(counts, "w")
    docs = long.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "w", "z", "n"))).alias("x"))
    return docs.select("key", F.col("x.w").alias("w"), F.col("x.z").alias("z"), F.flatten("x.n").alias("n")), None


def _sample(matrix, totals: np.ndarray, words: int, alpha: float, beta: float, seed: int, rounds: int, own: bool):
    """New topics for the tokens of every document; `own` tells that the counts hold these tokens themselves."""
    k = len(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = matrix.value if matrix is not None else None
        for b in batches:
            lengths = b.column("w").value_lengths().fill_null(0).to_numpy()
            w, z = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("w", "z"))
            doc, at = np.repeat(np.arange(b.num_rows), lengths), np.arange(len(w))
            n = (held[w] if held is not None else b.column("n").flatten().to_numpy().reshape(-1, k)).astype(float)
            in_words = (n - np.eye(k)[z] if own else n) + beta
            in_topics = (totals - np.eye(k)[z] if own else totals) + beta * words
            # draws depend on the document alone, so that a repeated task gives the same
            first = np.repeat(b.column("h").to_numpy().astype(np.uint64), lengths)
            place = at - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for r in range(rounds):
                in_doc = np.zeros((b.num_rows, k))
                np.add.at(in_doc, (doc, z), 1)
                p = np.cumsum(in_words / in_topics * (in_doc[doc] - np.eye(k)[z] + alpha), axis=1)
                with np.errstate(over="ignore"):
                    x = first + (place.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(seed + r)) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
                z = np.minimum((p < (u * p[:, -1])[:, None]).sum(1), k - 1) if len(w) else z
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h"), b.column("w"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(z.astype(np.int32)))], ["key", "h", "w", "z"])

    return run


@dataclass
class TopicModel:
    """`index` is (term, id), `counts` (w, n array<int>): the number of each word's tokens in each topic."""

    index: DataFrame
    counts: DataFrame
    totals: list[int]
    words: int
    alpha: float
    beta: float
    seed: int

    def terms(self) -> DataFrame:
        """(term, topic, count, share): what each topic consists of, without zeros."""
        long = self.index.join(self.counts.select(F.col("w").alias("id"), F.posexplode("n").alias("topic", "count")), "id").filter("count > 0")
        total = F.element_at(F.array(*[F.lit(t) for t in self.totals]), F.col("topic") + 1)
        return long.select("term", "topic", F.col("count").cast("bigint").alias("count"), ((F.col("count") + self.beta) / (total + self.beta * self.words)).alias("share"))

    def transform(self, df: DataFrame, key: str, words: str, rounds: int = 20) -> DataFrame:
        """(key, topics array<double>): each document's shares, drawn in `rounds` with the model's counts fixed; documents of unknown
        words only have no row."""
        k = len(self.totals)
        docs = _first(index_transform(df.filter(F.col(key).isNotNull()), key, words, self.index), key, k, self.seed)
        state, matrix = _with_counts(docs, self.counts, self.words, k)
        held = df.sparkSession.sparkContext.broadcast(matrix) if matrix is not None else None
        run = _sample(held, np.array(self.totals, float), self.words, self.alpha, self.beta, self.seed, rounds, False)
        out = state.withColumn("h", F.xxhash64("key")).select("key", "h", "w", "z", "n").mapInArrow(run, _schema(docs))
        shares = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: (F.size(F.filter("z", lambda x: x == t)) + self.alpha) / (F.size("z") + self.alpha * k))
        return out.select(F.col("key").alias(key), shares.alias("topics"))


def _schema(docs: DataFrame) -> str:
    return f"key {docs.schema['key'].dataType.simpleString()}, h bigint, w array<bigint>, z array<int>"


def _first(docs: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, w, z): tokens with topics drawn by a hash of document and place."""
    d = docs.select(F.col(key).alias("key"), F.col("ids").alias("w")).filter(F.size("w") > 0)
    return d.withColumn("z", F.transform("w", lambda w, i: F.pmod(F.xxhash64(F.col("key"), i, F.lit(seed)), F.lit(k)).cast("int")))


def gibbs_fit(df: DataFrame, key: str, words: str, k: int = 10, max_iter: int = 100, alpha: float | None = None, beta: float = 0.01, seed: int = 42) -> TopicModel:
    """Latent Dirichlet allocation by Gibbs sampling over the word arrays of documents with a unique `key`.

    Each round every token's topic is drawn from its word's and document's counts of the round before, its own taken out. The table of
    words and topics goes to the tasks if it has at most CELLS numbers; a larger one is joined to the tokens. Null keys and empty
    documents are left out; `alpha` is 50 / k unless given.
    """
    alpha = 50.0 / k if alpha is None else alpha
    df = df.filter(F.col(key).isNotNull())
    index = staged(index_fit(df, words), "words")
    size = index.count()
    state = staged(_first(index_transform(df, key, words, index), key, k, seed).withColumn("h", F.xxhash64("key")), "topics")
    for r in range(max_iter + 1):
        counts = staged(_counts(state, k), "counts")
        sums = counts.agg(*[F.sum(F.get("n", F.lit(t))).alias(f"t{t}") for t in range(k)]).first()
        totals = [int(x or 0) for x in sums]
        if r == max_iter:
            break
        docs, matrix = _with_counts(state, counts, size, k)
        held = df.sparkSession.sparkContext.broadcast(matrix) if matrix is not None else None
        docs = docs if "h" in docs.columns else docs.withColumn("h", F.xxhash64("key"))
        run = _sample(held, np.array(totals, float), size, alpha, beta, seed + 7919 * (r + 1), 1, True)
        state = cut(docs.select("key", "h", "w", "z", "n").mapInArrow(run, _schema(state)))
        if held is not None:
            held.unpersist()
    return TopicModel(index, counts, totals, size, alpha, beta, seed)


def log_likelihood(model: TopicModel, df: DataFrame, key: str, words: str) -> DataFrame:
    """(log_likelihood, tokens, perplexity) of documents under the model, by their drawn shares."""
    topics = model.transform(df, key, words)
    tokens = df.select(F.col(key).alias("key"), F.explode(words).alias("term")).groupBy("key", "term").agg(F.count("*").alias("m"))
    p = tokens.join(model.terms().groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("topic", "share"))).alias("shares")), "term").join(topics.withColumnRenamed(key, "key"), "key")
    least = [model.beta / (t + model.beta * model.words) for t in model.totals]
    p = p.withColumn("p", F.aggregate(F.zip_with(F.transform("topics", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.array(*map(F.lit, least)), lambda a, b: a["x"] * F.coalesce(F.try_element_at("shares", a["i"]), b)), F.lit(0.0), lambda s, x: s + x))
    a = p.agg(F.sum(F.col("m") * F.log("p")).alias("log_likelihood"), F.sum("m").alias("tokens"))
    return a.withColumn("perplexity", F.exp(-F.col("log_likelihood") / F.col("tokens")))
