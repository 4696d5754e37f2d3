"""Queries of problem 8. Many packings are equally good, so SQL tells only what must hold of any."""
from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged, table
from .packing import pack, token_lengths

CAPACITY = 2048


def vocabulary_file() -> str:
    """The byte-level BPE file: SILEXA_VOCABULARY, or the one of the installed public tokenizers."""
    if path := os.environ.get("SILEXA_VOCABULARY"):
        return path
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.json"))
    return "/opt/tokenizers/byte_bpe_50k.json"


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every post, or piece of a post above the capacity, with its container."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pack(token_lengths(docs, "doc_id", "text", vocabulary_file()), "doc_id", "n_tokens", CAPACITY)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: posts assigned, posts that miss or repeat a token, posts split without need, containers too full,
    and whether the containers are within 2 % (and one) of the least number that could hold the tokens."""
    lengths = staged(token_lengths(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", vocabulary_file()), "lengths")
    p = staged(pack(lengths, "doc_id", "n_tokens", CAPACITY), "packing")
    each = p.groupBy("doc_id").agg(F.sum("length").alias("sum"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"))
    each = lengths.join(each, "doc_id", "left").agg(
        F.count("pieces").alias("posts"), F.count_if((F.col("sum") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("broken"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("split"), F.sum("n_tokens").alias("tokens")
    )
    full = p.groupBy("container").agg(F.sum("length").alias("sum")).agg(F.count_if(F.col("sum") > CAPACITY).alias("overfull"), F.count("*").alias("n"))
    return each.crossJoin(full).select("posts", "broken", "split", "overfull", (F.col("n") <= F.ceil(F.col("tokens") / CAPACITY) * 1.02 + 1).alias("tight"))


QUERIES = {"p8_containers": p8_containers, "p8_checks": p8_checks}
SQL = {"p8_checks": "SELECT count(*) AS posts, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS overfull, true AS tight FROM documents"}
