import pytest
from pyspark.sql import functions as F

from silexa.operators import reshape
from silexa.sources import readers, writers


def lines(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


@pytest.mark.parametrize("fmt", readers.FORMATS)
def test_formats_round_trip(spark, tmp_path, fmt):
    d = spark.createDataFrame([(1, "a,b\tc", 2.5), (2, 'say "x"', 0.5)], "i int, s string, v double")
    writers.write(d, str(tmp_path / fmt), fmt)
    back = readers.read(spark, str(tmp_path / fmt), fmt).select("i", "s", "v").orderBy("i").collect()
    assert [(r["i"], r["s"], r["v"]) for r in back] == [(1, "a,b\tc", 2.5), (2, 'say "x"', 0.5)]
    with pytest.raises(Exception, match="exist"):
        writers.write(d, str(tmp_path / fmt), fmt)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read(spark, "x", "orc")
    with pytest.raises(ValueError):
        writers.write(spark.range(1), "x", "orc")


def test_libsvm(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:0.5 3:2\n\n2 2:1\n3 1:bad 4:1e-2\n")
    out = readers.read_libsvm(spark, str(tmp_path / "a.txt")).orderBy("label").collect()
    assert [(r["label"], list(r["idx"]), list(r["val"])) for r in out] == [(0.0, [0, 2], [0.5, 2.0]), (1.0, [1], [1.0]), (2.0, [3], [0.01])]
    (tmp_path / "b.txt").write_text("-1 1:1\n+1 2:1\n")
    assert sorted(r["label"] for r in readers.read_libsvm(spark, str(tmp_path / "b.txt")).collect()) == [0.0, 1.0]
    assert readers.read_libfm(spark, str(tmp_path / "b.txt")).filter("label = -1").first()["idx"] == [1]
    writers.write_libsvm(spark.createDataFrame([(1.0, [3, 0], [2.0, 1.0])], "label double, idx array<int>, val array<double>"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1.0 1:1.0 4:2.0"
    assert readers.num_features(readers.read_libfm(spark, str(tmp_path / "a.txt"))) == 5
    one = spark.createDataFrame([([0],), (None,)], "idx array<int>")
    assert readers.num_features(one) == 1 and readers.num_features(one.filter("idx IS NULL")) == 0


def test_records(spark):
    d = readers.parse_raw_docs(lines(spark, "d1\t2\ta  b", "d2\tx\t", "d3")).collect()
    assert [(r["id"], r["words"]) for r in d] == [("d1", ["a", "b"]), ("d2", []), ("d3", [])] and d[0]["label"] == 2.0 and d[1]["label"] != d[1]["label"]
    assert readers.parse_docs(lines(spark, "1 x 3"), False, False).first()["words"] == [1, 3]
    p = readers.parse_raw_points(lines(spark, "p\t1\ta:b:2,c:3,c:4,bad")).first()
    assert p["features"] == {"a:b": 2.0, "c": 3.0}
    q = readers.parse_labeled_points(lines(spark, "p\t1\t3:1.5|1:2 0:x")).first()
    assert (q["idx"], q["val"]) == ([3, 1], [1.5, 2.0])
    assert [tuple(r) for r in readers.parse_rates(lines(spark, "4.5 1 2", "3 4", "bad")).collect()] == [(1, 2, 4.5), (3, 4, 0.0)]
    assert tuple(readers.parse_separated_rates(lines(spark, "1::2::3.5::99")).first()) == (1, 2, 3.5)
    s = readers.parse_svd_points(lines(spark, "x\t1\t0:1 2:3,5:1,")).first()
    assert (s["u_idx"], s["i_val"], s["g_idx"]) == ([0, 2], [1.0], [])
    assert [tuple(r) for r in readers.parse_edges(lines(spark, " 1 2", "a b")).collect()] == [(1, 2, 1.0)]
    assert [tuple(r) for r in readers.parse_weighted_edges(lines(spark, "(1, 2, 0.5)")).collect()] == [(1, 2, 0.5)]
    assert tuple(readers.parse_predictions(lines(spark, "i\t1\t0.5")).first()) == ("i", 1.0, 0.5)
    assert readers.string_table(lines(spark, "a,b", "c")).columns == ["_c0", "_c1"]
    v = readers.to_vector(spark.createDataFrame([([1], [2.0])], "idx array<int>, val array<double>"), 3).first()["features"]
    assert v.toArray().tolist() == [0.0, 2.0, 0.0]


def test_reshape(spark):
    assert [r[0] for r in reshape.choose_columns(lines(spark, "a|b|c", "x"), "value", [3, 1], "|").collect()] == ["c|a", "|x"]
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k int, v double")
    ids = reshape.row_ids(d, ["v", "k"]).orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(50)) and [(r["v"], r["k"]) for r in ids] == sorted((r["v"], r["k"]) for r in ids)
    a, b = reshape.hash_split(d, "k", 0.4)
    assert a.count() + b.count() == 50 and a.join(b, "k").count() == 0
    t = reshape.transpose(spark.createDataFrame([("p", 1.0, 2.0), ("q", 3.0, 4.0)], "n string, x double, y double"), "n", ["x", "y"])
    assert {r["name"]: (r["p"], r["q"]) for r in t.collect()} == {"x": (1.0, 3.0), "y": (2.0, 4.0)}
    assert sum(x.count() for x in reshape.random_split(d, 0.3)) == 50


def test_sql_script(spark):
    src = spark.createDataFrame([(1, "a;b"), (2, "c")], "i int, s string")
    out = reshape.sql_script(spark, "CREATE OR REPLACE TEMP VIEW o AS SELECT s FROM t WHERE s = 'a;b'; -- x;y\n/* z; */", {"t": src}, ["o"])
    assert [r[0] for r in out["o"].collect()] == ["a;b"]
    with pytest.raises(Exception):
        reshape.sql_script(spark, "SELEC 1", {}, [])
    assert not [x for x in spark.catalog.listDatabases() if x.name.startswith("silexa_")]


def test_file_system_and_stages(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    fs = writers.FileSystem(spark)
    d = str(tmp_path / "dir")
    assert fs.mkdirs(d) and fs.exists(d) and fs.list(d) == []
    (tmp_path / "dir" / "a").write_text("1")
    assert fs.copy(f"{d}/a", f"{d}/b") and fs.rename(f"{d}/b", f"{d}/c") and [x[-1] for x in fs.list(d)] == ["a", "c"] and fs.delete(d) and not fs.exists(d)
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "s string, v double")
    first = Pipeline(stages=[StringIndexer(inputCol="s", outputCol="i")]).fit(df)
    assert writers.load_stages(spark, str(tmp_path / "t")) == []
    writers.save_stages(spark, [], first, str(tmp_path / "t"))
    chain = writers.save_stages(spark, writers.load_stages(spark, str(tmp_path / "t")), VectorAssembler(inputCols=["i", "v"], outputCol="f"), str(tmp_path / "u"))
    assert len(chain.stages) == 2 and chain.transform(df).select(F.col("f")).count() == 2


def test_local_files(tmp_path):
    from silexa.sources import local

    p = tmp_path / "d" / "x"
    local.write_map(p, {"a": 1, "b": "c\td"})
    assert local.read_map(p) == {"a": "1", "b": "c\td"}
    local.write_map_of_maps(p, {"a": {"x": 1}, "b": {"x": 2}})
    assert local.read_map_of_maps(p) == {"a": {"x": "1"}, "b": {"x": "2"}}
    assert local.invert_map_of_maps({"a": {"x": 1}, "b": {"x": 2}}) == {"x": {"a": 1, "b": 2}}
    local.write_separated(p, [["h", "i"], ["a,b", 2]])
    assert local.read_separated(p, header=True) == [["a,b", "2"]]
    local.write_object(p, {"k": [1, None]})
    assert local.read_object(p) == {"k": [1, None]}
    local.write_lines(p, ["é", 2])
    assert local.read_lines(p) == ["é", "2"]
