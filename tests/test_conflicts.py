"""Notes, blocked presentations and donors on odd rows."""

from matchloom.operators import conflicts


def test_annotated(spark):
    ranks = [(1, "a", 1), (1, "b", 2), (1, None, 3), (1, "c", 4), (2, None, 1), (2, "b", 2), (2, "a", 3), (3, "a", 1), (3, "b", 6), (4, "c", 1), (4, "a", 2), (5, "a", 1), (5, "b", 2), (5, "a", 3)]
    pairs = [("a", "b", "k1"), ("b", "a", "k1"), ("c", "a", "k2"), (None, "a", "x"), ("a", "a", "y")]
    values, seen = [("a", "red"), ("b", "blue"), ("c", "red"), ("b", None)], [(1, "red"), (2, "blue"), (2, "blue"), (4, None), (5, "red")]
    got = conflicts.annotated(
        spark.createDataFrame(ranks, "q int, p string, rank int"), spark.createDataFrame(pairs, "a string, b string, conflict string"), spark.createDataFrame(values, "p string, value string"),
        spark.createDataFrame(seen, "q int, value string"), "q", "p", 5,
    ).collect()
    assert {r.q: (r.top1, list(r.members), list(r.conflicts), r.selectable) for r in got} == {
        1: ("a", ["a", "b", "c"], ["k1", "k2"], None), 2: ("b", ["a", "b"], ["k1"], "b"), 4: ("c", ["a", "c"], ["k2"], None), 5: ("a", ["a", "b"], ["k1"], "a"),
    }
    assert len(got) == 4 and all((r.selectable is not None) == (r.status == "conflict_resolved_by_text") for r in got)


def test_contradicting(spark):
    refs = spark.createDataFrame([(0, "p", "c1"), (1, "p", "c2"), (2, None, "c1"), (3, "q", "c1")], "i int, photo string, card string")
    photos = spark.createDataFrame([("p", "c1", "k"), ("p", "c1", "k"), (None, "c1", "n")], "photo string, card string, conflict string")
    assert [(r.i, r.conflict) for r in conflicts.contradicting(refs, photos, "photo", "card").collect()] == [(0, "k")]


def test_presentations(spark):
    steps = spark.createDataFrame([(0, "m", "a", "b"), (1, "m", "b", "a"), (2, "n", "a", "c"), (3, "n", None, "a"), (3, "m", "a", "b")], "step int, kind string, x string, y string")
    pairs = spark.createDataFrame([("b", "a", "k"), ("a", "b", "other")], "a string, b string, conflict string")
    shown = lambda last: {r.kind: r.n for r in conflicts.presentations(steps, pairs, last).collect()}
    assert shown(None) == {"m": 3} and shown(0) == {"m": 1} and shown(9) == {"m": 8} and shown(-1) == {}


def test_donors(spark):
    giving = [(1, "x", 5), (2, "x", 3), (3, "x", 3), (4, None, 1), (5, "z", 1), (2, "x", 3)]
    asking = [(9, "x"), (2, "x"), (8, None), (5, "z"), (7, "none")]
    got = conflicts.donors(spark.createDataFrame(giving, "k int, g string, o int"), spark.createDataFrame(asking, "k int, g string"), "k", ["g"], ["o"]).collect()
    assert {r.k: r.donor for r in got} == {9: 2, 2: 3, 8: 4, 5: None, 7: None} and len(got) == 5
