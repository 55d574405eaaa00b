"""What grows with the number of drawings is not sent through the driver's memory."""

import re

import pytest

from draftgraph.plans import survey_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [lambda spark: Q.drawn_walls(spark, SF)[0], lambda spark: Q.drawn_walls(spark, SF)[1], lambda spark: Q.documents(spark, SF), lambda spark: Q._built(spark, SF)], ids=["walls", "dropped", "documents", "built"])
def test_no_broadcast_whatever_spark_estimates(spark, make):
    """The tables are so small here that Spark would broadcast each, and so would it the files of many
    regular drawings. The last plan is short, too: earlier steps end in tables."""
    plan = make(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan
    assert len(re.findall(r"\bExchange ", plan)) < 60
