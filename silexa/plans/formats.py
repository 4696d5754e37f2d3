"""Queries of the readers, writers and reshaping operators."""
from __future__ import annotations

import tempfile

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape
from ..session import stage_path, table
from ..sources import local, readers, writers
from .statistics import _r


def _round_trip(df: DataFrame, fmt: str) -> DataFrame:
    """Written in a format and read back."""
    path = stage_path(df.sparkSession, "trip")
    writers.write(df, path, fmt)
    return readers.read(df.sparkSession, path, fmt)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def format_csv(spark, d):
    t = _round_trip(_parts(spark, d), "csv")
    return t.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"), F.sum(F.col("p_size").cast("bigint")).alias("size"))


def format_tsv(spark, d):
    t = _round_trip(_parts(spark, d), "tsv")
    return t.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"), F.sum(F.col("p_size").cast("bigint")).alias("size"))


def format_json(spark, d):
    t = _round_trip(_parts(spark, d), "json")
    return t.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"), F.sum(F.col("p_size").cast("bigint")).alias("size"))


def format_libsvm(spark, d):
    """LibSVM lines written and read: labels 0/1/2 of the flags, four features."""
    li = table(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = li.select(
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0).alias("label"), F.array(*[F.lit(i) for i in range(4)]).alias("idx"), F.array(*cols).alias("val")
    )
    path = stage_path(spark, "libsvm")
    writers.write_libsvm(rows, path)
    back = readers.read_libsvm(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.sum(F.get("val", F.lit(i))), 2).alias(c) for i, c in enumerate(cols)])


def format_labeled_points(spark, d):
    """`id<tab>label<tab>i:v,i:v` lines of the sparse points, parsed."""
    p = table(spark, d, "labeled_points").filter("fs_idx IS NOT NULL AND point_id IS NOT NULL")
    e = F.transform(F.arrays_zip("fs_idx", "fs_val"), lambda x: F.concat_ws(":", x["fs_idx"].cast("string"), x["fs_val"].cast("string")))
    lines = p.select(F.concat_ws("\t", "point_id", F.coalesce(F.col("label").cast("string"), F.lit("NaN")), F.array_join(e, ",")).alias("value"))
    out = readers.parse_labeled_points(lines)
    return out.select("id", F.size("idx").alias("n"), F.round(F.aggregate("val", F.lit(0.0), lambda a, x: a + x), 4).alias("total")).distinct()


def format_raw_docs(spark, d):
    lines = table(spark, d, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("1.5"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("value"))
    return readers.parse_raw_docs(lines).select("id", "label", F.size("words").alias("words"))


def format_raw_points(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("1"), F.concat(F.lit("a:size:"), F.col("p_size"), F.lit(",price:"), F.col("p_retailprice"))).alias("value"))
    p = readers.parse_raw_points(lines)
    return p.select("id", "label", F.try_element_at("features", F.lit("a:size")).alias("size"), F.round(F.try_element_at("features", F.lit("price")), 2).alias("price"))


def format_rates(spark, d):
    lines = table(spark, d, "rates").filter("label IS NOT NULL AND NOT isnan(label) AND user_id IS NOT NULL AND item_id IS NOT NULL").select(F.concat_ws(" ", "label", "user_id", "item_id").alias("value"))
    r = readers.parse_rates(lines)
    return r.groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


def format_svd_points(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("user"), (F.col("o_orderkey") % 100).cast("int").alias("item"), F.lit(1.0).alias("rating"))
    p = readers.rates_to_svd_points(r)
    return p.select("id", "label", F.get("u_idx", F.lit(0)).alias("u"), F.get("i_idx", F.lit(0)).alias("i"), F.size("g_idx").alias("g"))


def format_edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws(" ", F.col("l_suppkey") % 50, F.col("l_partkey") % 50).alias("value"))
    return readers.parse_edges(lines).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def format_json_points(spark, d):
    p = readers.json_to_labeled_points(table(spark, d, "part").select((F.col("p_size") % 3 + 1).alias("y"), "p_retailprice", "p_size"), "y")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("features", F.lit(0))), 2).alias("price"), F.round(F.sum(F.get("features", F.lit(1))), 2).alias("size"))


def format_json_rates(spark, d):
    r = readers.json_to_rates(table(spark, d, "orders"), "o_custkey", "o_orderkey")
    return r.groupBy("user").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


def reshape_choose_columns(spark, d):
    lines = table(spark, d, "supplier").select(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    return reshape.choose_columns(lines, "value", [3, 1])


def reshape_sql_script(spark, d):
    script = """CREATE OR REPLACE TEMP VIEW big AS SELECT *, 'a;b' AS tag FROM ev WHERE value > 50;
    CREATE OR REPLACE TEMP VIEW result AS
      SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k, max(tag) AS tag,
             CAST(percentile(value, 0.5) AS DOUBLE) AS mid FROM big GROUP BY event_type -- one; row; a type
    ;"""
    return _r(reshape.sql_script(spark, script, {"ev": table(spark, d, "events")}, ["result"])["result"], 6)


def reshape_sql_window(spark, d):
    """Windows, ranges and set operations, as a script reaches them."""
    script = """CREATE OR REPLACE TEMP VIEW result AS
      SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS k,
             round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS near
      FROM ev WHERE event_id IN (SELECT event_id FROM ev EXCEPT SELECT event_id FROM ev WHERE value < 10)"""
    return reshape.sql_script(spark, script, {"ev": table(spark, d, "events")}, ["result"])["result"]


def reshape_transpose(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.max("l_tax"), 6).alias("tax"))
    return reshape.transpose(t, "l_returnflag", ["quantity", "tax"])


def reshape_restore_names(spark, d):
    t = table(spark, d, "part").withColumn("p_size_new", F.col("p_size") * 2)
    return reshape.restore_names(t.select("p_partkey", "p_size", "p_brand", "p_size_new"), ["p_size"], "_new")


def reshape_row_ids(spark, d):
    return reshape.row_ids(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


def reshape_row_normalize(spark, d):
    return reshape.row_normalize(table(spark, d, "part"), "p_name", "p_partkey")


def reshape_shift_labels(spark, d):
    t = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("y"))
    return reshape.shift_labels(t, "y")


def reshape_hash_split(spark, d):
    a, b = reshape.hash_split(table(spark, d, "orders"), "o_orderkey", 0.3)
    return a.select("o_orderkey", F.lit("first").alias("part")).union(b.select("o_orderkey", F.lit("second").alias("part")))


def reshape_random_split(spark, d):
    """Rows of both parts, rows in both, and whether the first has about its share."""
    a, b = (x.select("o_orderkey") for x in reshape.random_split(table(spark, d, "orders"), 0.3))
    n = a.withColumn("p", F.lit(1)).union(b.withColumn("p", F.lit(2))).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    return n.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("twice"), (F.abs(F.avg((F.col("p") == 1).cast("double")) - 0.3) < 0.03).alias("share"))


def reshape_sample(spark, d):
    """Whether a sample has about its share of the rows, and each at most once."""
    s = reshape.sample(table(spark, d, "orders"), 0.2).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k"))
    return s.crossJoin(table(spark, d, "orders").agg(F.count("*").alias("rows"))).select("rows", (F.col("n") == F.col("k")).alias("once"), (F.abs(F.col("n") / F.col("rows") - 0.2) < 0.03).alias("share"))


def reshape_add_column(spark, d):
    """A list beside the rows of a table in the order of its file."""
    n = table(spark, d, "nation").coalesce(1).orderBy("n_nationkey")
    return reshape.add_column(n.select("n_nationkey"), [f"v{i}" for i in range(20)], "extra", "string")


def reshape_row_normalize_ids(spark, d):
    """Lines without an id get consecutive ones."""
    lines = reshape.row_normalize(table(spark, d, "part"), "p_name")
    x = lines.select(F.substring_index("line", "\t", 1).cast("bigint").alias("id"))
    return x.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


def format_libfm(spark, d):
    """LibFM lines: labels and indices are kept as they are."""
    li = table(spark, d, "lineitem")
    path = stage_path(spark, "libfm")
    writers.write_lines(li.select(F.concat_ws(" ", F.when(F.col("l_returnflag") == "A", "-1").otherwise("3"), F.concat(F.lit("0:"), F.col("l_quantity")), F.concat(F.lit("7:"), F.col("l_tax")))), path)
    back = readers.read_libfm(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.max(F.array_max("idx")).alias("last"), *[F.round(F.sum(F.get("val", F.lit(i))), 2).alias(c) for i, c in enumerate(("l_quantity", "l_tax"))])


def format_text(spark, d):
    """Rows as separated lines, written, copied, renamed and read again as a table of strings."""
    fs, path = writers.FileSystem(spark), stage_path(spark, "text")
    writers.write_lines(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "|")
    fs.copy(path, f"{path}-copy")
    fs.rename(f"{path}-copy", f"{path}-moved")
    fs.delete(path)
    back = readers.read_lines(spark, f"{path}-moved").select(F.split("value", r"\|").alias("f"))
    return back.select(F.get("f", F.lit(0)).cast("bigint").alias("s_suppkey"), F.get("f", F.lit(1)).alias("s_name"), F.get("f", F.lit(2)).cast("int").alias("s_nationkey"), F.lit(fs.exists(path)).alias("first_left"))


def format_stages(spark, d):
    """Two stages kept beside the tables they made, loaded and applied as one pipeline."""
    from pyspark.ml.feature import SQLTransformer

    n, path = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), stage_path(spark, "stages")
    one, two = (SQLTransformer(statement=f"SELECT *, {e} FROM __THIS__") for e in ("n_nationkey * 2 AS twice", "twice + n_regionkey AS more"))
    writers.save_stages(spark, [], one, f"{path}-a")
    writers.save_stages(spark, before := writers.load_stages(spark, f"{path}-a"), two, f"{path}-b")
    chain = writers.load_stages(spark, f"{path}-b")
    for stage in chain:
        n = stage.transform(n)
    return n.withColumn("stages", F.lit(len(chain))).withColumn("before", F.lit(len(before)))


def format_local(spark, d):
    """Small files on the driver: separated values, maps and maps of maps."""
    rows = [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    with tempfile.TemporaryDirectory() as at:  # the driver's own files, read again at once
        local.write_separated(f"{at}/a.csv", rows)
        local.write_map(f"{at}/m.tsv", {k: n for k, n, _ in rows})
        local.write_map_of_maps(f"{at}/mm.tsv", {r: {k: n for k, n, x in rows if x == r} for _, _, r in rows})
        names, deep = local.read_map(f"{at}/m.tsv"), local.invert_map_of_maps(local.read_map_of_maps(f"{at}/mm.tsv"))
        out = [(int(k), names[k], int(r), deep[k][r]) for k, _, r in local.read_separated(f"{at}/a.csv")]
    return spark.createDataFrame(out, "n_nationkey int, n_name string, n_regionkey int, deep string")


def format_dense(spark, d):
    """Sparse arrays as ML vectors: their size, entries and sums."""
    p = table(spark, d, "labeled_points").filter("point_id IS NOT NULL AND size(fs_idx) > 0")
    size = readers.num_features(p, "fs_idx")
    v = readers.to_vector(p, size, "fs_idx", "fs_val").select("point_id", vector_to_array("features").alias("x"))
    return v.select("point_id", F.size("x").alias("size"), F.size(F.filter("x", lambda e: e != 0)).alias("entries"), F.round(F.aggregate("x", F.lit(0.0), lambda a, e: a + e), 4).alias("total")).distinct()


def format_docs(spark, d):
    """Lines of words as numbers; others are dropped."""
    t = table(spark, d, "docs").filter("rec_id IS NOT NULL AND words IS NOT NULL")
    lines = t.select(F.concat_ws("\t", "rec_id", F.lit("1"), F.array_join(F.transform("words", lambda w: F.coalesce(w.cast("string"), F.lit("x"))), " ")).alias("value"))
    return readers.parse_docs(lines).select("id", F.size("words").alias("n"), F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")).distinct()


_AGG = "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        format_csv, format_tsv, format_json, format_libsvm, format_labeled_points, format_raw_docs, format_raw_points, format_rates, format_svd_points, format_edges, format_json_points, format_json_rates,
        reshape_choose_columns, reshape_sql_script, reshape_sql_window, reshape_transpose, reshape_restore_names, reshape_row_ids, reshape_row_normalize, reshape_shift_labels, reshape_hash_split, reshape_random_split, reshape_sample, reshape_add_column, reshape_row_normalize_ids, format_libfm, format_docs, format_text, format_stages, format_local, format_dense,
    )
}
SQL = {
    "format_csv": _AGG,
    "format_tsv": _AGG,
    "format_json": _AGG,
    "format_libsvm": "SELECT CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 1.0 ELSE 2.0 END AS label, count(*) AS n, " + ", ".join(f"round(sum({c}), 2) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY 1",
    "format_labeled_points": "SELECT DISTINCT point_id AS id, CAST(len(fs_idx) AS INTEGER) AS n, round(coalesce(list_sum(fs_val), 0), 4) AS total FROM labeled_points WHERE fs_idx IS NOT NULL AND point_id IS NOT NULL",
    "format_raw_docs": "SELECT CAST(doc_id AS VARCHAR) AS id, 1.5::DOUBLE AS label, CAST(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS INTEGER) AS words FROM documents",
    "format_raw_points": "SELECT CAST(p_partkey AS VARCHAR) AS id, 1.0::DOUBLE AS label, CAST(p_size AS DOUBLE) AS size, round(p_retailprice, 2) AS price FROM part",
    "format_rates": "SELECT item_id AS item, count(*) AS n, round(avg(label), 6) AS mean FROM rates WHERE label IS NOT NULL AND NOT isnan(label) AND user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1",
    "format_svd_points": "SELECT CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey % 100 AS VARCHAR) AS id, 1.0::DOUBLE AS label, CAST(o_custkey AS INTEGER) AS u, CAST(o_orderkey % 100 AS INTEGER) AS i, 0 AS g FROM orders",
    "format_edges": "SELECT l_suppkey % 50 AS src, l_partkey % 50 AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL",
    "format_json_points": "SELECT CAST(p_size % 3 AS DOUBLE) AS label, count(*) AS n, round(sum(p_retailprice), 2) AS price, round(CAST(sum(p_size) AS DOUBLE), 2) AS size FROM part GROUP BY 1",
    "format_json_rates": "SELECT CAST(o_custkey AS INTEGER) AS user, count(*) AS n, CAST(count(*) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "reshape_choose_columns": "SELECT CAST(s_nationkey AS VARCHAR) || ',' || CAST(s_suppkey AS VARCHAR) AS value FROM supplier",
    "reshape_sql_script": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, 'a;b' AS tag, round(quantile_cont(value, 0.5), 6) AS mid FROM events WHERE value > 50 GROUP BY 1",
    "reshape_sql_window": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS near FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value < 10)",
    "reshape_transpose": " UNION ALL ".join(f"SELECT '{n}' AS name, " + ", ".join(f"round({e} FILTER (l_returnflag = '{f}'), 6) AS {f}" for f in "ANR") + " FROM lineitem" for n, e in (("quantity", "avg(l_quantity)"), ("tax", "max(l_tax)"))),
    "reshape_restore_names": "SELECT p_partkey, p_size * 2 AS p_size, p_brand FROM part",
    "reshape_row_ids": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS id FROM orders",
    "reshape_row_normalize": "SELECT CAST(p_partkey AS VARCHAR) || chr(9) || 'NaN' || chr(9) || p_name AS line FROM part",
    "reshape_shift_labels": "SELECT p_partkey, CAST(p_size % 4 AS DOUBLE) AS y FROM part",
    "reshape_hash_split": "SELECT o_orderkey, CASE WHEN floor(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 1000) < 300 THEN 'first' ELSE 'second' END AS part FROM orders",
    "reshape_random_split": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS twice, true AS share FROM orders",
    "reshape_sample": "SELECT count(*) AS rows, true AS once, true AS share FROM orders",
    "reshape_add_column": "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'v' || n_nationkey END AS extra FROM nation",
    "reshape_row_normalize_ids": "SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM part",
    "format_libfm": "SELECT CASE l_returnflag WHEN 'A' THEN -1.0::DOUBLE ELSE 3.0 END AS label, count(*) AS n, 7 AS last, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1",
    "format_text": "SELECT s_suppkey, s_name, s_nationkey, false AS first_left FROM supplier",
    "format_stages": "SELECT n_nationkey, n_regionkey, n_nationkey * 2 AS twice, n_nationkey * 2 + n_regionkey AS more, 2 AS stages, 1 AS before FROM nation",
    "format_local": "SELECT n_nationkey, n_name, n_regionkey, n_name AS deep FROM nation",
    "format_dense": "SELECT DISTINCT point_id, CAST((SELECT max(list_max(fs_idx)) + 1 FROM labeled_points) AS INTEGER) AS size, CAST(len(list_filter(fs_val, lambda x: x <> 0)) AS INTEGER) AS entries, round(list_sum(fs_val), 4) AS total FROM labeled_points WHERE point_id IS NOT NULL AND len(fs_idx) > 0",
    "format_docs": "SELECT DISTINCT rec_id AS id, CAST(len(list_filter(words, lambda x: x IS NOT NULL)) AS INTEGER) AS n, CAST(coalesce(list_sum(words), 0) AS BIGINT) AS total FROM docs WHERE rec_id IS NOT NULL AND words IS NOT NULL",
}
