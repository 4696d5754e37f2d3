"""Queries of the text, feature-table and rule operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rules, text
from ..session import table
from .statistics import _r


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return text.segment(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "words")


def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_english("text").alias("clean"))


def text_segment(spark, d):
    return _docs(spark, d).select("doc_id", F.size("words").alias("n"), F.get("words", F.lit(0)).alias("first_word"))


def text_term_counts(spark, d):
    return text.term_counts(_docs(spark, d), "words")


def text_bigram_counts(spark, d):
    return text.term_counts(_docs(spark, d), "words", "bigram").filter("count >= 3")


def text_biterm_counts(spark, d):
    return text.term_counts(_docs(spark, d), "words", "biterm", by_document=True).filter("count >= 5")


def text_document_frequency(spark, d):
    return text.term_counts(_docs(spark, d), "words", by_document=True)


def text_word_filter(spark, d):
    docs = _docs(spark, d)
    stop = text.default_stop_words(spark).filter("word IN ('the', 'and')").union(text.default_stop_words(spark, "german").filter("word = 'und'"))
    out = text.filter_words(docs, "doc_id", "words", text.bad_words(docs, "words", stop, 5, 100_000, 50, 2, 10))
    return out.select("doc_id", F.array_join("words", " ").alias("words"))


def text_word_index(spark, d):
    return text.index_fit(_docs(spark, d), "words")


def text_word_index_transform(spark, d):
    docs = _docs(spark, d)
    out = text.index_transform(docs, "doc_id", "words", text.index_fit(docs, "words"))
    return out.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def text_idf(spark, d):
    return _r(text.idf_fit(_docs(spark, d), "words"), 8)


def text_tf_idf(spark, d):
    docs = _docs(spark, d)
    return _r(text.tf_idf(docs, "doc_id", "words", text.idf_fit(docs, "words")), 6)


def _feature_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("label"), F.create_map(F.lit("price"), "o_totalprice", F.lit("year"), F.year("o_orderdate").cast("double")).alias("features"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"))
    b = li.select("id", F.lit(2.0).alias("label"), F.create_map(F.lit("quantity"), "q", F.lit("year"), "n").alias("features"))
    return [a, b]


def feature_merge(spark, d):
    m = text.feature_merge(*_feature_tables(spark, d))
    return _r(m.select("id", "label", *[F.try_element_at("features", F.lit(f)).alias(f) for f in ("price", "quantity", "year")]), 2)


def feature_index(spark, d):
    a = _feature_tables(spark, d)[0].select("id", F.map_keys("features").alias("names"))
    return text.index_fit(a, "names")


def feature_index_transform(spark, d):
    a = _feature_tables(spark, d)[0]
    out = text.feature_index_transform(a, "id", "features", text.index_fit(a.select(F.map_keys("features").alias("names")), "names"))
    return out.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def feature_min_max(spark, d):
    long = text.explode_features(_feature_tables(spark, d)[0], "id", "features")
    return _r(text.min_max_transform(long, text.min_max_fit(long), "id"), 6)


#: Sets of at least so many orders per million; the rules' least confidence.
SUPPORT, CONFIDENCE = 180, 0.05


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their parts."""
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return _baskets(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.col("item").cast("string")).alias("items"))


def rules_apriori(spark, d):
    return _r(rules.apriori(_baskets(spark, d), "l_orderkey", "item", SUPPORT / 1e6), 8).drop("size")


def rules_brands(spark, d):
    """Brands of an order: many frequent sets of up to three."""
    b = _baskets(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand"), "item")
    return _r(rules.apriori(b, "l_orderkey", "p_brand", 0.004, 3), 8).drop("size")


def rules_association(spark, d):
    return _r(rules.rules_of(rules.apriori(_baskets(spark, d), "l_orderkey", "item", SUPPORT / 1e6), CONFIDENCE), 8)


def rules_fp_growth(spark, d):
    f = rules.fp_growth(_arrays(spark, d), "items", SUPPORT / 1e6, CONFIDENCE).freqItemsets
    return f.select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("count"))


def rules_fp_predict(spark, d):
    b = _arrays(spark, d)
    return rules.fp_predict(rules.fp_growth(b, "items", SUPPORT / 1e6, CONFIDENCE), b).select("l_orderkey", "items", "prediction")


def rules_prefix_span(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("x"))
    s = s.select(F.transform("x", lambda e: F.array(e["o_orderpriority"])).alias("sequence"))
    p = rules.prefix_span(s, "sequence", 0.2, 3)
    return p.select(F.array_join(F.transform("sequence", lambda x: F.array_join(x, "+")), ">").alias("pattern"), "freq")


def scalar_time(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", *[c.alias(n) for n, c in scalars.time_parts("s").items()])


def scalar_math(spark, d):
    e = table(spark, d, "events")
    x = (F.col("value") / 50 - 1)
    return _r(e.select("event_id", scalars.sigmoid(x).alias("sigmoid"), scalars.sigmoid(x * 10, 6.0).alias("clamped"), scalars.kernel(x, "Polynomial").alias("square")), 8)


_W = "WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9\\-]{2,})', 1) AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d) "
_B = "WITH b AS (SELECT DISTINCT l_orderkey AS b, CAST(l_partkey AS VARCHAR) AS i FROM lineitem), n AS (SELECT count(DISTINCT b) AS n FROM b), least AS (SELECT n * 0.00018 - 1e-9 AS least FROM n) "
_L1 = "l1 AS (SELECT i, count(*) AS c FROM b GROUP BY i HAVING count(*) >= (SELECT least FROM least)), "
_L2 = "l2 AS (SELECT x.i AS i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.b = y.b AND x.i < y.i GROUP BY ALL HAVING count(*) >= (SELECT least FROM least)), "
_L3 = "l3 AS (SELECT x.i AS i, y.i AS j, z.i AS k, count(*) AS c FROM b x JOIN b y ON x.b = y.b AND x.i < y.i JOIN b z ON y.b = z.b AND y.i < z.i GROUP BY ALL HAVING count(*) >= (SELECT least FROM least)), u AS (SELECT i AS items, c FROM l1 UNION ALL SELECT i || ',' || j, c FROM l2 UNION ALL SELECT i || ',' || j || ',' || k, c FROM l3) "
#: Rules of sets of up to three items.
_RULES = """, r AS (SELECT [i] AS a, j AS k, c FROM l2 UNION ALL SELECT [j], i, c FROM l2 UNION ALL SELECT [i, j], k, c FROM l3 UNION ALL SELECT [i, k], j, c FROM l3 UNION ALL SELECT [j, k], i, c FROM l3),
q AS (SELECT a AS antecedent, r.k AS consequent, r.c / x.c AS confidence, r.c / x.c / (y.c / n) AS lift, r.c / n AS support FROM r JOIN u x ON x.items = array_to_string(a, ',') JOIN l1 y ON y.i = r.k, n WHERE r.c / x.c >= 0.05) """

QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_segment, text_term_counts, text_bigram_counts, text_biterm_counts, text_document_frequency, text_word_filter, text_word_index, text_word_index_transform, text_idf, text_tf_idf,
        feature_merge, feature_index, feature_index_transform, feature_min_max, rules_apriori, rules_brands, rules_association, rules_fp_growth, rules_fp_predict, rules_prefix_span, scalar_time, scalar_math,
    )
}
SQL = {
    "text_clean": "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '([a-z0-9\\-]{2,})', 1), ' ') AS clean FROM documents",
    "text_segment": _W + "SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first_word FROM d",
    "text_term_counts": _W + "SELECT term, count(*) AS count FROM e GROUP BY term",
    "text_bigram_counts": _W + ", b AS (SELECT term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS term FROM e) SELECT term, count(*) AS count FROM b WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 3",
    "text_biterm_counts": _W + ", p AS (SELECT DISTINCT x.doc_id, least(x.term, y.term) || ' ' || greatest(x.term, y.term) AS term FROM e x JOIN e y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos < x.pos + 10) SELECT term, count(*) AS count FROM p GROUP BY term HAVING count(*) >= 5",
    "text_document_frequency": _W + "SELECT term, count(DISTINCT doc_id) AS count FROM e GROUP BY term",
    "text_word_filter": _W + """, c AS (SELECT term, count(*) AS n FROM e GROUP BY term), bad AS (SELECT term FROM c WHERE n < 5 OR n > 100000 OR length(term) < 2 OR length(term) > 10
      UNION (SELECT term FROM c ORDER BY n DESC, term LIMIT 50) UNION SELECT unnest(['the', 'and', 'und']))
      SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS words FROM e WHERE term NOT IN (SELECT term FROM bad) GROUP BY doc_id""",
    "text_word_index": _W + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM e)",
    "text_word_index_transform": _W + ", i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM e)) SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM e JOIN i USING (term) GROUP BY doc_id",
    "text_idf": _W + "SELECT term, round(ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT doc_id) + 1)), 8) AS idf FROM e GROUP BY term",
    "text_tf_idf": _W + ", f AS (SELECT term, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT doc_id) + 1)) AS idf FROM e GROUP BY term) SELECT doc_id, term, round(count(*) * any_value(idf), 6) AS weight FROM e JOIN f USING (term) GROUP BY doc_id, term",
    "feature_merge": """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, * FROM orders)
      SELECT coalesce(o.id, l.id) AS id, CASE WHEN o.id IS NOT NULL AND o_orderkey % 3 <> 0 THEN 1.0::DOUBLE WHEN l.id IS NOT NULL THEN 2.0 END AS label, round(o_totalprice, 2) AS price, round(q, 2) AS quantity,
      CAST(coalesce(n, year(o_orderdate)) AS DOUBLE) AS year FROM o FULL JOIN l ON o.id = l.id""",
    "feature_index": "SELECT 'price' AS term, CAST(0 AS BIGINT) AS id UNION ALL SELECT 'year', 1",
    "feature_index_transform": "SELECT CAST(o_orderkey AS VARCHAR) AS id, '0,1' AS ids, round(o_totalprice + year(o_orderdate), 2) AS total FROM orders",
    "feature_min_max": """WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'price' AS feature, o_totalprice AS v FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'year', CAST(year(o_orderdate) AS DOUBLE) FROM orders)
      SELECT id, feature, round((v - min(v) OVER (PARTITION BY feature)) / (max(v) OVER (PARTITION BY feature) - min(v) OVER (PARTITION BY feature) + 1e-10), 6) AS value FROM f""",
    "rules_apriori": _B + ", " + _L1 + _L2 + _L3 + "SELECT items, c AS count, round(c / n, 8) AS support FROM u, n",
    "rules_brands": _B.replace("CAST(l_partkey AS VARCHAR) AS i FROM lineitem", "p_brand AS i FROM lineitem JOIN part ON p_partkey = l_partkey").replace("0.00018", "0.004") + ", " + _L1 + _L2 + _L3 + "SELECT items, c AS count, round(c / n, 8) AS support FROM u, n",
    "rules_association": _B + ", " + _L1 + _L2 + _L3 + _RULES + "SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(confidence, 8) AS confidence, round(lift, 8) AS lift, round(support, 8) AS support FROM q",
    "rules_fp_growth": _B + ", " + _L1 + _L2 + _L3 + "SELECT items, c AS count FROM u",
    "rules_fp_predict": _B + ", " + _L1 + _L2 + _L3 + _RULES + """, s AS (SELECT b, list(i ORDER BY i) AS s FROM b GROUP BY b),
      p AS (SELECT b, list(DISTINCT consequent ORDER BY consequent) AS p FROM s JOIN b USING (b) JOIN q ON i = antecedent[1] AND list_has_all(s, antecedent) AND NOT list_contains(s, consequent) GROUP BY b)
      SELECT b AS l_orderkey, array_to_string(s, ' ') AS items, coalesce(array_to_string(p, ' '), '') AS prediction FROM s LEFT JOIN p USING (b)""",
    "scalar_time": "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(week(ts) AS INTEGER) AS week, CAST(isodow(ts) AS INTEGER) AS weekday, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute FROM events",
    "scalar_math": "WITH x AS (SELECT event_id, value / 50 - 1 AS x FROM events) SELECT event_id, round(1 / (1 + exp(-x)), 8) AS sigmoid, round(CASE WHEN x * 10 > 6 THEN 1.0 WHEN x * 10 < -6 THEN 0.0 ELSE 1 / (1 + exp(-x * 10)) END, 8) AS clamped, round(x * x, 8) AS square FROM x",
}
_PATTERNS = """WITH s AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), n AS (SELECT 0.2 * count(DISTINCT o_custkey) AS least FROM s),
f AS (SELECT p AS pattern, count(DISTINCT o_custkey) AS freq FROM s GROUP BY p UNION ALL SELECT x.p || '>' || y.p, count(DISTINCT x.o_custkey) FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.k < y.k GROUP BY 1
  UNION ALL SELECT x.p || '>' || y.p || '>' || z.p, count(DISTINCT x.o_custkey) FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.k < y.k JOIN s z ON z.o_custkey = y.o_custkey AND y.k < z.k GROUP BY 1)
SELECT pattern, freq FROM f, n WHERE freq >= least"""
SQL["rules_prefix_span"] = _PATTERNS
