import pytest

from silexa.programs import PROGRAMS, main


@pytest.fixture
def run(spark, tmp_path):
    def go(name, **kw):
        PROGRAMS[name](spark, **{k: (str(tmp_path / v[1:]) if isinstance(v, str) and v.startswith("@") else v) for k, v in kw.items()})

    return go


def csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)


def test_statistics(run, tmp_path, spark):
    csv(tmp_path, "a.csv", "x,y,s\n1,2.5,u\n3,4.5,v\n5,0.5,u\n")
    run("summary_report", input="@a.csv", columns="x,y", output="@o1")
    run("central_position", input="@a.csv", columns="x,y", output="@o2")
    run("deviation", input="@a.csv", columns="x", output_metrics="@o3", output_z_score="@o4")
    run("covariance_matrix", input="@a.csv", columns="x,y", output="@o5")
    run("mean_difference", input="@a.csv", second="@a.csv", output="@o6")
    run("ratio", input="@a.csv", column="s", value="u", output="@o7")
    run("pivot", input="@a.csv", output="@o8", group="s", pivot="x", value="y")
    assert {r["metric"]: float(r["x"]) for r in spark.read.option("header", True).csv(str(tmp_path / "o2")).collect()}["median"] == 3.0
    assert float(spark.read.option("header", True).csv(str(tmp_path / "o7")).first()[0]) == pytest.approx(2 / 3)


def test_trees_and_forest(run, tmp_path, spark):
    csv(tmp_path, "t.csv", "id,x,t\n" + "\n".join(f"{i},{i},{1.0 if i < 30 else 5.0}" for i in range(80)))
    run("cart_train", input="@t.csv", features="x", label="t", model="@m", max_bins=200)
    run("tree_predict", input="@t.csv", model="@m", output="@p.parquet")
    assert {r["prediction"] for r in spark.read.parquet(str(tmp_path / "p.parquet")).collect()} == {1.0, 5.0}
    run("gbdt_train", input="@t.csv", features="x", label="t", model="@g", num_round=1, max_depth=2)
    run("tree_predict", input="@t.csv", model="@g", output="@q.parquet")
    assert spark.read.parquet(str(tmp_path / "q.parquet")).filter("prediction <> t").count() <= 5
    run("iforest_train", input="@t.csv", features="x", model="@f", num_trees=5)
    run("iforest_predict", input="@t.csv", model="@f", output="@s.parquet")
    assert spark.read.parquet(str(tmp_path / "s.parquet")).count() == 80
    run("evaluate_regression", input="@p.parquet", label="t", prediction="prediction", output="@e.parquet")
    assert spark.read.parquet(str(tmp_path / "e.parquet")).filter("metric = 'rmse'").first()["value"] == 0.0


def test_points_rates_graphs_and_text(run, tmp_path, spark):
    csv(tmp_path, "pts", "\n".join(f"{i}\t{i % 2}\t{i % 2}:1,5:0.5" for i in range(20)))
    run("logistic_regression_train", input="@pts", model="@lr", max_iter=5, learn_rate=1.0)
    run("logistic_regression_predict", input="@pts", model="@lr", output="@lp.parquet")
    assert all(float(int(r["id"]) % 2) == r["prediction"] for r in spark.read.parquet(str(tmp_path / "lp.parquet")).collect())
    csv(tmp_path, "rates", "\n".join(f"{1 + (u * i) % 3} {u} {i}" for u in range(5) for i in range(4)))
    run("nmf_train", input="@rates", model="@nmf", k=2, max_iter=2)
    run("nmf_predict", input="@rates", model="@nmf", output="@np.parquet")
    assert spark.read.parquet(str(tmp_path / "np.parquet")).filter("prediction > 0").count() == 20
    csv(tmp_path, "edges", "1 2\n2 3\n3 1\n4 1\n")
    run("pagerank_train", edges="@edges", model="@pr", max_iter=3)
    csv(tmp_path, "names", "1 one\n")
    run("graph_predict", model="@pr", output="@top.parquet", top_k=2, names="@names")
    assert spark.read.parquet(str(tmp_path / "top.parquet")).count() == 2
    csv(tmp_path, "docs", "a\t1\tred blue red\nb\t0\tblue\n")
    run("tf_idf_fit", input="@docs", model="@idf")
    run("tf_idf_transform", input="@docs", model="@idf", output="@w.parquet")
    assert spark.read.parquet(str(tmp_path / "w.parquet")).count() == 3
    run("word_index_fit", input="@docs", model="@ix")
    run("word_index_transform", input="@docs", model="@ix", output="@ids")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["a\t1 0 1", "b\t0"]
    csv(tmp_path, "cols", "1,2,3\n")
    run("choose_columns", input="@cols", columns="3,1", output="@c")
    assert spark.read.text(str(tmp_path / "c")).first()[0] == "3,1"
    csv(tmp_path, "in.json", '{"name": "x", "age": 3}\n{"name": "y", "age": 5}\n')
    csv(tmp_path, "s.sql", "CREATE OR REPLACE TEMP VIEW old AS SELECT name FROM people WHERE age > 4;")
    run("run_script", script="@s.sql", inputs=f"people:{tmp_path}/in.json", outputs=f"old:{tmp_path}/old")
    assert [r["name"] for r in spark.read.json(str(tmp_path / "old")).collect()] == ["y"]


def test_usage(capsys):
    assert main([]) == 2 and "pagerank_train edges model [damping_factor=0.85]" in capsys.readouterr().out
