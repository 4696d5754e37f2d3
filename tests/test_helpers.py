"""Schema checks, addresses, names and escapes."""
import pytest
from pyspark.sql import functions as F

from silexa.functions import run, scalars, schema
from silexa.operators import reshape, stats
from silexa.sources.jdbc import Address


def test_schema_checks(spark):
    d = spark.createDataFrame([(1, "a", [1.0])], "i int, s string, v array<double>")
    assert schema.require(d, i="numeric", s="string", v=("vector", "string")) is d
    with pytest.raises(ValueError, match="'x' is missing.*'s' is string, not numeric"):
        schema.require(d, x="int", s="numeric")
    assert schema.append_column(d, "new") == "new"
    with pytest.raises(ValueError):
        schema.append_column(d, "i")


def test_addresses():
    a = Address.parse("jdbc:mysql://db.example:3306/shop?useSSL=false&x")
    assert (a.kind, a.host, a.port, a.database, dict(a.options)) == ("mysql", "db.example", 3306, "shop", {"useSSL": "false", "x": ""})
    assert a.url() == "jdbc:mysql://db.example:3306/shop?useSSL=false&x" and a.url(False) == "jdbc:mysql://db.example:3306/?useSSL=false&x"
    assert Address.parse("jdbc:postgresql://h/d").port is None
    with pytest.raises(ValueError):
        Address.parse("http://h/d")


def test_names_and_times():
    assert run.unique_name("a-") != run.unique_name("a-") and run.evaluation_paths("/m/")["roc"] == "/m/evaluation/roc"
    with run.timed("nothing") as t:
        pass
    assert t["seconds"] >= 0


@pytest.mark.parametrize("text,want", [(r"a\tb", "a\tb"), (r"a\\n", r"a\n"), (r"\\\n", "\\\n"), (r"\u00e9\u20AC!", "é€!"), (r"\ud83d\ude00", "😀"), (r"\x\u12", r"\x\u12"), ("\\", "\\"), ("", ""), (None, None), ("line\nbreak", "line\nbreak")])
def test_unescape(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.unescape("t")).first()[0] == want


def test_rows_in_order(spark):
    d = spark.createDataFrame([(f"r{i}",) for i in range(23)], "v string").repartition(4).orderBy("v")
    out = reshape.row_normalize(d, "v").collect()
    assert sorted(int(r["line"].split("\t")[0]) for r in out) == list(range(23))
    wide = reshape.add_column(d, [1.5, 2.5], "extra", "double").orderBy("v").collect()
    assert [r["extra"] for r in wide[:3]] == [1.5, 2.5, None] and len(wide) == 23
    assert stats.lower_median(spark.createDataFrame([(1.0,), (2.0,), (None,), (7.0,), (9.0,)], "x double"), ["x"]).first()["median"] == 2.0
    assert d.select(F.count("*")).first()[0] == 23
