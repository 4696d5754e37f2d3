"""Batch programs: read files, run an operator, write files.

    python -m silexa.programs NAME key=value ...

Every program is a function of (spark, parameters); `PROGRAMS` maps names to functions, whose keyword defaults are the
program's defaults. Models are written as parquet tables or pipeline folders, results in the format of the name's suffix.
"""
from __future__ import annotations

import inspect
import json
import os
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, gradient, graph, ml, reshape, rules, stats, text, trees
from .operators.iforest import IsolationForest, IsolationForestModel
from .sources import readers, writers

PROGRAMS: dict = {}


def program(f):
    PROGRAMS[f.__name__] = f
    return f


def _names(x: str) -> list[str]:
    return [c for c in x.replace(",", " ").split() if c]


def _in(spark: SparkSession, path: str) -> DataFrame:
    for fmt in readers.FORMATS:
        if path.rstrip("/").endswith(f".{fmt}"):
            return readers.read(spark, path, fmt)
    return readers.read_csv(spark, path)


def _out(df: DataFrame, path: str) -> None:
    for fmt in readers.FORMATS:
        if path.rstrip("/").endswith(f".{fmt}"):
            return writers.write(df, path, fmt)
    return writers.write_csv(df, path)


def _numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


# --- statistics -----------------------------------------------------------------------------------------------------
@program
def summary_report(spark, input, columns, output, metrics="", bins=10):
    r = stats.statistics_report(_in(spark, input), _names(columns), _names(metrics) or None, int(bins))
    _out(r.withColumn("density", F.to_json("density")), output)


@program
def central_position(spark, input, columns, output, metrics="mode median mean"):
    _out(stats.central_position(_in(spark, input), _names(columns), _names(metrics)), output)


@program
def deviation(spark, input, columns, output_metrics, output_z_score, metrics="skewness kurtosis"):
    df = _in(spark, input)
    _out(stats.deviation(df, _names(columns), _names(metrics)), output_metrics)
    _out(stats.z_score(df, _names(columns)), output_z_score)


@program
def covariance_matrix(spark, input, columns, output):
    _out(stats.covariance_matrix(_in(spark, input), _names(columns)), output)


@program
def mean_estimation(spark, input, output):
    df = _in(spark, input)
    _out(stats.mean_estimation(df, _numeric(df)), output)


@program
def variance_estimation(spark, input, output):
    df = _in(spark, input)
    _out(stats.variance_estimation(df, _numeric(df)), output)


@program
def mean_difference(spark, input, second, output):
    df = _in(spark, input)
    _out(stats.mean_difference(df, _in(spark, second), _numeric(df)), output)


@program
def variance_ratio(spark, input, second, output):
    df = _in(spark, input)
    _out(stats.variance_ratio(df, _in(spark, second), _numeric(df)), output)


@program
def ratio(spark, input, column, value, output):
    _out(stats.ratio(_in(spark, input), column, value), output)


@program
def ratio_difference(spark, input, second, column, value, output):
    _out(stats.ratio_difference(_in(spark, input), _in(spark, second), column, value), output)


@program
def pivot(spark, input, output, group="year", pivot="month", value="count"):
    _out(stats.pivot(_in(spark, input), group, pivot, value), output)


# --- rules, features --------------------------------------------------------------------------------------------------
def _items(spark: SparkSession, path: str, column: str) -> DataFrame:
    return reshape.row_ids(_in(spark, path).select(rules.baskets(column).alias("items")), ["items"])


@program
def apriori(spark, input, column, output, min_support=0.7):
    _out(rules.apriori(_items(spark, input, column).select("id", F.explode("items").alias("i")), "id", "i", float(min_support)), output)


@program
def fp_growth_train(spark, input, column, model, output_rules, min_support=0.2, min_confidence=0.6, prediction="prediction"):
    m = rules.fp_growth(_items(spark, input, column), "items", float(min_support), float(min_confidence), prediction)
    m.write().overwrite().save(model)
    writers.write(m.associationRules, output_rules, "json")


@program
def fp_growth_predict(spark, input, column, model, output):
    from pyspark.ml.fpm import FPGrowthModel

    _out(rules.fp_predict(FPGrowthModel.load(model), _items(spark, input, column)), output)


@program
def pca_train(spark, input, features, model, output_explained, k=3):
    m, explained = ml.pca_fit(_in(spark, input), _names(features), int(k))
    writers.save_stages(spark, writers.load_stages(spark, input), m, model)
    m.write().overwrite().save(model)
    _out(explained, output_explained)


@program
def pca_transform(spark, input, model, output):
    _out(ml.pca_transform(PipelineModel.load(model), _in(spark, input)), output)


@program
def chi_square_select(spark, input, number, output):
    df = readers.read_libsvm(spark, input)
    n = readers.num_features(df)
    dense = readers.to_vector(df, n).select("label", F.expr("transform(sequence(0, %d), i -> coalesce(try_element_at(map_from_arrays(idx, val), i), 0D))" % (n - 1)).alias("x"))
    out = ml.chi_square_select(dense, "x", "label", int(number))
    writers.write_libsvm(out.select("label", F.sequence(F.lit(0), F.size("selected") - 1).alias("idx"), F.col("selected").alias("val")), output)


# --- trees and forests --------------------------------------------------------------------------------------------------
@program
def gbt_regressor_train(spark, input, features, label, model, impurity="variance", max_depth=5, max_iter=20):
    ml.gbt_regressor(_in(spark, input), _names(features), label, int(max_iter), int(max_depth), impurity).write().overwrite().save(model)


@program
def gbt_regressor_predict(spark, input, model, output, prediction="prediction"):
    _out(ml.gbt_predict(PipelineModel.load(model), _in(spark, input), prediction), output)


@program
def iforest_train(spark, input, features, model, num_trees=100, contamination=0.35, bootstrap=False, max_depth=100, seed=123456, max_samples=256):
    p = IsolationForest(int(num_trees), float(max_samples), 1.0, int(max_depth), float(contamination), str(bootstrap).lower() == "true", int(seed))
    p.fit(_in(spark, input), _names(features)).save(model)


@program
def iforest_predict(spark, input, model, output):
    _out(IsolationForestModel.load(spark, model).transform(_in(spark, input)), output)


def _tree_json(n: trees.Node) -> dict:
    d = {"prediction": n.prediction, "count": n.count, "impurity": n.impurity}
    return d if n.feature < 0 else d | {"feature": n.feature, "threshold": n.threshold, "left": _tree_json(n.left), "right": _tree_json(n.right)}


def _tree_of(d: dict) -> trees.Node:
    n = trees.Node(d["prediction"], d["count"], d["impurity"])
    if "feature" in d:
        n.feature, n.threshold, n.left, n.right = d["feature"], d["threshold"], _tree_of(d["left"]), _tree_of(d["right"])
    return n


def _save_trees(spark: SparkSession, e: trees.Ensemble, path: str) -> None:
    rounds = [[_tree_json(t) for t in r] if isinstance(r, list) else _tree_json(r) for r in e.trees]
    spark.createDataFrame([(json.dumps({"trees": rounds, "features": e.features, "combine": e.combine, "classes": list(e.classes)}),)], "value string").write.mode("overwrite").text(path)


def _load_trees(spark: SparkSession, path: str) -> trees.Ensemble:
    d = json.loads(spark.read.text(path).first()[0])
    return trees.Ensemble([[_tree_of(t) for t in r] if isinstance(r, list) else _tree_of(r) for r in d["trees"]], d["features"], d["combine"], tuple(d["classes"]))


def _cart(impurity, max_depth, max_bins, min_node_size, min_info_gain) -> trees.CART:
    return trees.CART(str(impurity).lower(), int(max_depth), int(max_bins), float(min_node_size), float(min_info_gain))


@program
def cart_train(spark, input, features, label, model, impurity="variance", max_depth=10, max_bins=32, min_node_size=15, min_info_gain=1e-6):
    tree = _cart(impurity, max_depth, max_bins, min_node_size, min_info_gain).fit(_in(spark, input), _names(features), label)
    _save_trees(spark, trees.Ensemble([tree], _names(features), "sum"), model)


@program
def random_forest_train(spark, input, features, label, key, model, impurity="variance", max_depth=10, max_bins=32, min_node_size=15, min_info_gain=1e-6, num_trees=20, row_rate=0.6, col_rate=0.6):
    _save_trees(spark, trees.random_forest(_in(spark, input), _names(features), label, key, _cart(impurity, max_depth, max_bins, min_node_size, min_info_gain), int(num_trees), float(row_rate), float(col_rate)), model)


@program
def gbdt_train(spark, input, features, label, model, max_depth=10, max_bins=32, min_node_size=15, min_info_gain=1e-6, num_round=10):
    _save_trees(spark, trees.gbdt(_in(spark, input), _names(features), label, _cart("variance", max_depth, max_bins, min_node_size, min_info_gain), int(num_round)), model)


@program
def gbrt_train(spark, input, features, label, model, max_depth=10, max_bins=32, min_node_size=15, min_info_gain=1e-6, num_round=10, learn_rate=0.02):
    _save_trees(spark, trees.gbrt(_in(spark, input), _names(features), label, _cart("variance", max_depth, max_bins, min_node_size, min_info_gain), int(num_round), float(learn_rate))[0], model)


@program
def tree_predict(spark, input, model, output):
    """For the models of cart_train, random_forest_train, gbdt_train and gbrt_train."""
    _out(_load_trees(spark, model).transform(_in(spark, input)), output)


# --- gradient models ------------------------------------------------------------------------------------------------------
def _points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Long features and labels of labelled point lines."""
    p = readers.parse_labeled_points(readers.read_lines(spark, path))
    return gradient.sparse_to_long(p, "id", "idx", "val"), p.select("id", F.col("label").alias("y")).filter("NOT isnan(y)")


@program
def logistic_regression_train(spark, input, model, learn_rate=0.01, reg=0.01, max_iter=100):
    f, y = _points(spark, input)
    classes = int(y.agg(F.max("y")).first()[0] or 0) + 1
    gradient.softmax_fit(f, y, classes, float(learn_rate), float(reg), int(max_iter)).write.mode("overwrite").parquet(model)


@program
def logistic_regression_predict(spark, input, model, output):
    f, _ = _points(spark, input)
    _out(gradient.softmax_predict(f, spark.read.parquet(model)), output)


@program
def factorization_machine_train(spark, input, model, is_regression=True, learn_rate=0.001, k2=8, reg1=0.001, reg2=0.001, stdev=0.001, max_iter=50):
    f, y = _points(spark, input)
    m = gradient.fm_fit(f, y, str(is_regression).lower() == "true", int(k2), float(learn_rate), float(reg1), float(reg2), float(stdev), int(max_iter))
    m.params.write.mode("overwrite").parquet(f"{model}/params")
    spark.createDataFrame([(m.bias, m.k, m.regression, m.low, m.high)], "bias double, k int, regression boolean, low double, high double").write.mode("overwrite").parquet(f"{model}/meta")


@program
def factorization_machine_predict(spark, input, model, output):
    f, _ = _points(spark, input)
    m = spark.read.parquet(f"{model}/meta").first()
    _out(gradient.fm_predict(gradient.FMModel(spark.read.parquet(f"{model}/params"), *m), f), output)


@program
def nmf_train(spark, input, model, k=10, learn_rate=0.01, reg=0.01, max_iter=100):
    w, h = gradient.nmf_fit(readers.parse_rates(readers.read_lines(spark, input)), int(k), float(learn_rate), float(reg), int(max_iter))
    w.write.mode("overwrite").parquet(f"{model}/users")
    h.write.mode("overwrite").parquet(f"{model}/items")


@program
def nmf_predict(spark, input, model, output):
    _out(gradient.nmf_predict(readers.parse_rates(readers.read_lines(spark, input)), spark.read.parquet(f"{model}/users"), spark.read.parquet(f"{model}/items")), output)


def _svd(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    p = readers.parse_svd_points(readers.read_lines(spark, path))
    return (*[gradient.sparse_to_long(p, "id", f"{s}_idx", f"{s}_val") for s in "uig"], p.select("id", F.col("label").alias("y")))


@program
def svd_feature_train(spark, input, model, is_regression=True, k=20, learn_rate=0.01, reg=0.01, max_iter=100):
    m = gradient.svd_feature_fit(*_svd(spark, input), str(is_regression).lower() == "true", int(k), float(learn_rate), float(reg), int(max_iter))
    for name in ("users", "items", "globals"):
        getattr(m, name).write.mode("overwrite").parquet(f"{model}/{name}")
    spark.createDataFrame([(m.bias, m.k, m.regression)], "bias double, k int, regression boolean").write.mode("overwrite").parquet(f"{model}/meta")


@program
def svd_feature_predict(spark, input, model, output):
    meta = spark.read.parquet(f"{model}/meta").first()
    m = gradient.SVDFeatureModel(*[spark.read.parquet(f"{model}/{n}") for n in ("users", "items", "globals")], *meta)
    _out(gradient.svd_feature_predict(m, *_svd(spark, input)[:3]), output)


@program
def lda_train(spark, input, model, output_topics, k=10, max_iter=100):
    d = readers.parse_raw_docs(readers.read_lines(spark, input))
    m = ml.lda_fit(d, "words", int(k), int(max_iter))
    m.write().overwrite().save(model)
    writers.write(ml.lda_predict(m, d).select("id", "topics"), output_topics, "json")


@program
def lda_predict(spark, input, model, output):
    writers.write(ml.lda_predict(PipelineModel.load(model), readers.parse_raw_docs(readers.read_lines(spark, input))).select("id", "topics"), output, "json")


@program
def perplexity(spark, input, model, output):
    _out(ml.perplexity(PipelineModel.load(model), readers.parse_raw_docs(readers.read_lines(spark, input))), output)


@program
def word2vec_train(spark, input, model, k=100, learn_rate=0.025, max_window=3, iter=5, min_count=5):
    m = ml.word2vec_fit(readers.parse_raw_docs(readers.read_lines(spark, input)), "words", int(k), float(learn_rate), int(max_window), int(iter), int(min_count))
    m.write().overwrite().save(model)


# --- graphs -------------------------------------------------------------------------------------------------------------
def _edges(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    return graph.load_edges(readers.parse_edges(readers.read_lines(spark, path)), reverse=reverse)


@program
def pagerank_train(spark, edges, model, damping_factor=0.85, max_iter=15, reverse=True):
    graph.pagerank(_edges(spark, edges, str(reverse).lower() == "true"), float(damping_factor), int(max_iter)).write.mode("overwrite").parquet(model)


@program
def k_shell_train(spark, edges, model, dir="degree", weight=False):
    graph.k_shell(_edges(spark, edges), dir, str(weight).lower() == "true").write.mode("overwrite").parquet(model)


@program
def graph_predict(spark, model, output, top_k=20, names=""):
    """The vertices of greatest rank or shell, for the models of pagerank_train and k_shell_train."""
    m = spark.read.parquet(model)
    value = next(c for c in m.columns if c != "id")
    known = readers.read_lines(spark, names).select(F.split("value", r"\s+", 2).alias("f")).select(F.get("f", F.lit(0)).try_cast("long").alias("id"), F.get("f", F.lit(1)).alias("name")) if names else None
    _out(graph.top_k(m, value, int(top_k), names=known), output)


@program
def influence(spark, edges, output, seed="0", max_iter=200, threshold=0.8, runs=1):
    _out(graph.influence(_edges(spark, edges), [int(s) for s in seed.split()], float(threshold), int(runs), int(max_iter)), output)


# --- evaluation -----------------------------------------------------------------------------------------------------------
@program
def evaluate_regression(spark, input, label, prediction, output):
    _out(evaluate.regression_errors(_in(spark, input), label, prediction), output)


@program
def evaluate_multiclass(spark, input, label, prediction, output):
    _out(evaluate.multiclass(_in(spark, input), label, prediction), output)


@program
def evaluate_confusion(spark, input, label, prediction, output):
    df = _in(spark, input)
    _out(evaluate.confusion_matrix(df, label, prediction), f"{output}_evaluation/matrix")
    _out(evaluate.per_label(df, label, prediction), f"{output}_evaluation/index")


@program
def evaluate_binary(spark, input, label, score, output, bins=4):
    df = _in(spark, input)
    for name, table in (
        ("index", evaluate.binary_report(df, label, score)), ("frequent", evaluate.equal_frequency(df, label, score, int(bins))), ("width", evaluate.equal_width(df, label, score, int(bins))),
        ("pr", evaluate.pr_points(df, label, score)), ("roc", evaluate.roc_points(df, label, score)),
    ):
        _out(table, f"{output}_evaluation/{name}")


@program
def evaluate_predictions(spark, input, output):
    """Accuracy, precision, recall and errors of `id<tab>label<tab>prediction` files."""
    p = readers.parse_predictions(readers.read_lines(spark, input))
    e = evaluate.regression_errors(p, "label", "prediction")
    a = evaluate.accuracy_precision_recall(p, "label", "prediction")
    _out(e.union(a.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in a.columns])))), output)


# --- text and formats -----------------------------------------------------------------------------------------------------
def _docs(spark: SparkSession, path: str) -> DataFrame:
    return readers.parse_raw_docs(readers.read_lines(spark, path))


def _doc_lines(df: DataFrame, path: str, column: str = "words") -> None:
    writers.write_lines(df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), " ")), path)


@program
def segment_words(spark, input, output, has_id=True, has_label=True, separator="\t"):
    d = readers._fields(readers.read_lines(spark, input), str(has_id).lower() == "true", str(has_label).lower() == "true", separator)
    _doc_lines(readers.read_lines(spark, input).select(d[0].alias("id"), d[1].alias("label"), text.tokens(d[2]).alias("words")), output)


@program
def term_count(spark, input, output, term_type="unigram", is_doc_freq=False):
    _out(text.term_counts(_docs(spark, input), "words", term_type, str(is_doc_freq).lower() == "true"), output)


@program
def word_filter(spark, input, output, stop_words="", min_freq=5, max_freq="", top_n=100, min_len=2, max_len=10):
    d = _docs(spark, input)
    stop = readers.read_lines(spark, stop_words) if stop_words else None
    bad = text.bad_words(d, "words", stop, int(min_freq), int(max_freq) if max_freq else None, int(top_n), int(min_len), int(max_len))
    _doc_lines(text.filter_words(d, "id", "words", bad), output)


@program
def word_index_fit(spark, input, model):
    text.index_fit(_docs(spark, input), "words").write.mode("overwrite").parquet(model)


@program
def word_index_transform(spark, input, model, output):
    _doc_lines(text.index_transform(_docs(spark, input), "id", "words", spark.read.parquet(model)), output, "ids")


@program
def tf_idf_fit(spark, input, model):
    text.idf_fit(_docs(spark, input), "words").write.mode("overwrite").parquet(model)


@program
def tf_idf_transform(spark, input, model, output):
    _out(text.tf_idf(_docs(spark, input), "id", "words", spark.read.parquet(model)), output)


def _raw_points(spark: SparkSession, path: str) -> DataFrame:
    return readers.parse_raw_points(readers.read_lines(spark, path))


@program
def feature_index_fit(spark, input, model):
    text.index_fit(_raw_points(spark, input).select(F.map_keys("features").alias("names")), "names").write.mode("overwrite").parquet(model)


@program
def feature_index_transform(spark, input, model, output):
    t = text.feature_index_transform(_raw_points(spark, input), "id", "features", spark.read.parquet(model))
    writers.write_lines(t.select("id", F.array_join(F.zip_with("ids", "values", lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("string"))), ",").alias("fs")), output)


@program
def feature_merge(spark, input, second, output):
    m = text.feature_merge(_raw_points(spark, input), _raw_points(spark, second))
    writers.write_lines(m.select("id", "label", F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("fs")), output)


@program
def min_max_scale(spark, input, model, output):
    long = text.explode_features(_raw_points(spark, input), "id", "features")
    params = text.min_max_fit(long)
    params.write.mode("overwrite").parquet(model)
    _out(text.min_max_transform(long, params, "id"), output)


@program
def choose_columns(spark, input, columns, output, separator=","):
    writers.write_lines(reshape.choose_columns(readers.read_lines(spark, input), "value", [int(c) for c in _names(columns)], separator), output)


@program
def normalize_rows(spark, input, output, id_column="", label_column="", value_column="value"):
    writers.write_lines(reshape.row_normalize(_in(spark, input), value_column, id_column or None, label_column or None), output)


@program
def split_file(spark, input, output_1, output_2, ratio=0.5, header=False):
    df = _in(spark, input) if str(header).lower() == "true" else readers.read_lines(spark, input)
    for part, path in zip(reshape.random_split(df, float(ratio)), (output_1, output_2)):
        _out(part, path) if str(header).lower() == "true" else writers.write_lines(part, path)


@program
def run_script(spark, script, inputs, outputs):
    """`inputs` and `outputs` are `name:path;name:path`; inputs are JSON."""
    pairs = lambda s: dict(x.split(":", 1) for x in s.split(";") if x)
    with open(script, encoding="utf-8") as f:
        done = reshape.sql_script(spark, f.read(), pairs(inputs), list(pairs(outputs)))
    for name, path in pairs(outputs).items():
        writers.write_json(done[name], path)


@program
def libsvm_to_points(spark, input, output, is_class=True, libfm=False):
    df = readers.read_libfm(spark, input) if str(libfm).lower() == "true" else readers.read_libsvm(spark, input, str(is_class).lower() == "true")
    e = F.array_join(F.zip_with("idx", "val", lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("string"))), ",")
    df = reshape.row_ids(df.withColumn("at", F.monotonically_increasing_id()), ["at"])
    writers.write_lines(df.select("id", "label", e.alias("fs")), output)


@program
def json_to_points(spark, input, label, output, is_class=True):
    writers.write(readers.json_to_labeled_points(spark.read.json(input), label, str(is_class).lower() == "true"), output, "json")


@program
def json_to_rates(spark, input, user, item, output, rate=""):
    writers.write_lines(readers.json_to_rates(spark.read.json(input), user, item, rate).select("rating", "user", "item"), output, " ")


def main(args: list[str]) -> int:
    if not args or args[0] not in PROGRAMS:
        for name, f in sorted(PROGRAMS.items()):
            print(name, *[p.name if p.default is p.empty else f"[{p.name}={p.default}]" for p in list(inspect.signature(f).parameters.values())[1:]])
        return 2
    spark = SparkSession.builder.appName(args[0]).master(os.environ.get("SPARK_MASTER", "local[*]")).getOrCreate()
    PROGRAMS[args[0]](spark, **dict(a.split("=", 1) for a in args[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
