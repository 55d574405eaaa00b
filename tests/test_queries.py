"""Every drawing query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from draftgraph.plans import survey_queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"ag07", "exe02", "srt03", "ag08", "sem06", "sem07", "gr05", "gr06", "evl05"}  # others run the same operators


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(table, columns):
    return sorted(str([plain(v) for v in r]) for r in table[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in Q.SQL if n not in SLOW])
def test_same_as_sql(spark, duck, name):
    a, b = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "draftgraph"), tmp_path / "draftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'evl04' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
