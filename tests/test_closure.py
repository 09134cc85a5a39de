"""Walks of many rounds: what was seen is read by few tasks."""

from matchloom.operators import governance


def test_rounds_do_not_pile_up_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(9, 1), (None, 5), (40, 41)], "parent int, child int")
    got = governance.closure(edges, spark.createDataFrame([(1,)], "node int"))
    assert sorted(r.node for r in got.collect()) == list(range(1, 10)) and got.rdd.getNumPartitions() <= 9
