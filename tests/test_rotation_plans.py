"""What a task of the rotation steps has to hold at once: sorts between two shuffles add up, so they are counted."""

import pytest

from tailglass.queries import QUERIES


def last_stage(df):
    """The operators above the last shuffles of a plan."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is not None and depth > below:
            continue
        below = None
        name = line.lstrip(" :+-*(0123456789)").split(" ")[0]
        if name.endswith("Exchange"):
            below = depth
        found.append(name)
    return found


@pytest.mark.parametrize("name, most", [("parked_made", 4), ("rotation_holder", 3), ("parked_cursor", 4)])
def test_sorts_of_one_task(spark, sf_dir, name, most):
    """The lost logs and the copies for their join, and of each search its first stage; parked_made has the states of the
    chains besides, parked_cursor a join for its cursors."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        stage = last_stage(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in stage and "Exchange" in stage
    assert stage.count("Sort") <= most, stage
