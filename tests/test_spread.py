"""Rows of a group are dealt once, to as many tasks as there are rows for."""

import re

from pyspark.sql import functions as F

from matchloom.operators import conflicts, graph, ranking, replay, roster

from .test_dealt import plans
from .test_volumes import shuffled


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 10)
    assert graph.spread(spark.range(205), "id").rdd.getNumPartitions() == 21
    assert graph.spread(spark.range(5), "id").rdd.getNumPartitions() == 8
    assert graph.spread(spark.range(5), "id", rows=1000).rdd.getNumPartitions() == 100


def test_first_in_all_channels(spark):
    rows = [(1, 5, 3.0, 1.0), (1, 4, 3.0, 0.5), (2, 7, 1.0, 2.0), (2, 8, 2.0, None), (3, 9, 1.0, None), (4, 6, 9.0, 9.0), (4, 3, 9.0, 9.0), (4, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, k int, a double, b double")
    got = ranking.agreed_first(df, "g", "k", {"a": F.col("a"), "b": F.col("b")})
    assert sorted(map(tuple, got.collect())) == [(4, 3)]
    moved, _ = shuffled(spark, lambda: got)
    assert moved <= len(rows)


def test_listwise_rows_are_dealt_by_query(spark):
    rows = spark.createDataFrame([(q, k, k % 2, False) for q in range(50) for k in range(6)], "q int, k int, label int, ignored boolean")
    moved, got = shuffled(spark, lambda: roster.listwise_admitted(rows, "q", "k", "label", "ignored"))
    assert moved <= 320 and len(got) == 50 and all(r.admitted and (r.n, r.positives, r.kept) == (6, 3, 6) for r in got)


def test_rekeyed_ids_are_not_expanded(spark):
    rows = spark.createDataFrame([(1, [1, 2, 2]), (2, [1, 3]), (3, [4])], "k int, ids array<int>")
    mapping, got = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "old int, new string"), {}
    text = plans(spark, lambda: got.update({r.k: (r.state, r.ids) for r in replay.rekeyed(rows, "k", "ids", [], mapping, "old", "new").collect()}))
    assert "Expand" not in text and got == {1: ("ok", ["a", "b", "b"]), 2: ("merged", None), 3: ("unknown", None)}


def test_rankings_are_dealt_by_themselves_alone(spark):
    side = lambda rows, kind: spark.createDataFrame(rows, kind)
    ranks = side([(1, "x", 1), (1, "y", 2), (2, "x", 1), (2, "z", 2), (3, "y", 1), (3, "x", 6), (None, "x", 1), (None, "y", 2)], "g int, key string, rank int")
    pairs, values, got = side([("x", "y", "c")], "a string, b string, conflict string"), side([("x", "red"), ("y", "blue")], "key string, value string"), []
    text = plans(spark, lambda: got.extend(conflicts.annotated(ranks, pairs, values, side([(1, "blue"), (1, None), (2, "red")], "g int, value string"), "g", "key", 5).collect()))
    assert [tuple(r) for r in got] == [(1, "x", ["x", "y"], ["c"], "y", "conflict_resolved_by_text")]
    assert not re.search(r"hashpartitioning\(g#\d+, (y|value|key)#", text)
