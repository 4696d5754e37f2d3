"""The optional subpackage stays optional, and the queries are named and documented consistently."""
import importlib
import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_does_not_import_the_optional_subpackage():
    for p in (ROOT / "silexa").rglob("*.py"):
        if p.relative_to(ROOT / "silexa").parts[0] != "llm":
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", p.read_text(), re.M), p


def test_core_works_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "silexa", tmp_path / "silexa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 120


def test_core_goes_on_if_it_is_broken(tmp_path):
    import shutil

    shutil.copytree(ROOT / "silexa", tmp_path / "silexa", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "silexa" / "llm").mkdir(exist_ok=True)
    (tmp_path / "silexa" / "llm" / "catalog.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 120


def test_every_sql_has_its_query():
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "stats_summary" in q


def test_entry(spark):
    import os

    import pytest

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
