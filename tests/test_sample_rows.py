"""Sample lines are read once, and a line's fields are found once."""

from __future__ import annotations

from tracelake.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_samples_are_read_and_split_once(spark):
    plan = Q.QUERIES["a15_samples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("split(") == 1
