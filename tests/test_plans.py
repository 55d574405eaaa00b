"""Plans: near joins are equality joins, scans read the columns they need."""

import os

import pytest

from draftgraph.plans import survey_queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["jn01", "jn02", "jn03", "jn05", "jn06", "jn08", "j-nn02", "j-nn04", "flt01"])
def test_no_nested_loops(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_scans_are_pruned(spark):
    text = plan(Q.QUERIES["str01"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint>" in text
    assert "Python" not in text and "Pandas" not in text
    lines = plan(Q.QUERIES["jn01"](spark, SF))
    assert "o_totalprice" not in lines and "o_orderdate" not in lines


@pytest.mark.parametrize("name", ["str01", "jn01", "win01", "ag16", "evl04", "det06", "val01"])
def test_stays_in_the_engine(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert not any(w in text for w in ("MapInPandas", "FlatMapGroupsInPandas", "BatchEvalPython", "ArrowEvalPython"))
