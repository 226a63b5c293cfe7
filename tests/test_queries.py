"""Every query with an SQL twin gives the twin's rows."""

import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import registry
from tests.conftest import ROOT

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(registry.SQL))
def test_equals_its_twin(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(registry.SQL[name])
    at = {x[0]: k for k, x in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", list(registry.FOLDS))
def test_folds_give_rows(spark, name):
    assert registry.FOLDS[name](spark, DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{ROOT}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); print(len(q)); assert not any(x.startswith('op') or x == 'pipeline' for x in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) == len(registry.QUERIES), out.stderr
