"""The driver's contract: every query runs, matches its SQL, and nothing outside the text subpackage needs it."""

import ast
import datetime as dt
import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from emberglass.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else x.isoformat() if isinstance(x, dt.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    rows = df.select(*[df[c] for c in columns]).collect()
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        names = list(rel.columns)
        order = sorted(range(len(names)), key=names.__getitem__)
        assert columns == sorted(names)
        want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
        assert sorted(tuple(map(plain, r)) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_subpackage():
    for path in glob.glob(f"{ROOT}/emberglass/**/*.py", recursive=True):
        if os.sep + "llm" + os.sep in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", "") or ""
            assert "llm" not in module.split(".") and "llm" not in names, path


def test_entry_without_the_text_subpackage(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/emberglass", tmp_path / "emberglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith(('p3', 'p7', 'p8')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
