"""Every query that has SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from vireo import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.6g}"
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x) if x is not None and not isinstance(x, (int, bool)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = library.queries()[name](spark, SF)
    result = duck.execute(library.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in df.columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    """What the driver does: both llm folders and the pipeline gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for n in ("vireo", "__spark_entry__.py", "bench.py"):
        source = os.path.join(root, n)
        (shutil.copytree(source, tmp_path / n, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / n))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'name_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); import vireo.__main__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
