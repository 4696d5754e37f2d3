"""Queries of problems 9 and 10."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .leaks import leaked_passages
from .residue import residue


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold at least 12 consecutive words of an evaluation item."""
    found = leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", 12)
    return found.filter("exact").select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items that leaked, with the number of posts that hold them."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("posts"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold an evaluation item wholly or partly, also with a few letters changed: the alignment's score and place."""
    return leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", 12)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts of template residue, filler, an error page or a scripts-required notice."""
    return residue(table(spark, d, "documents"), "doc_id", "text", "source", "author").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_leaked_items": p9_leaked_items, "p9_passages": p9_passages, "p10_found": p10_found}
#: The entities that forum posts hold; others would be words of their own here.
_TEXT = "lower(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({t}, '</?[A-Za-z][^<>]*>|\\[/?[A-Za-z*][^\\[\\]\\n]*\\]', ' ', 'g'), '&#0?39;|&middot;|&quot;', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(8203), ''), chr(173), ''))"
_LEAKS = f"""
WITH d AS (SELECT doc_id AS k, regexp_extract_all({_TEXT.format(t="text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS k, regexp_extract_all({_TEXT.format(t="text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items),
dr AS (SELECT k, list_aggregate(w[i : i + 11], 'string_agg', ' ') AS r FROM d, unnest(range(1, len(w) - 10)) x(i)),
er AS (SELECT DISTINCT k, list_aggregate(w[i : i + 11], 'string_agg', ' ') AS r FROM e, unnest(range(1, len(w) - 10)) x(i))
"""
SQL = {
    "p9_found": _LEAKS + "SELECT DISTINCT dr.k AS doc_id, er.k AS item_id FROM dr JOIN er ON dr.r = er.r",
    "p9_leaked_items": _LEAKS + "SELECT er.k AS item_id, count(DISTINCT dr.k) AS posts FROM dr JOIN er ON dr.r = er.r GROUP BY er.k",
}
