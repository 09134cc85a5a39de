"""Replays and grids on hand-made rows: nulls, repeats, cuts, empty sides."""

import random

import pytest

from matchloom.operators import geometry, governance, replay, vector


def test_packets(spark):
    base = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, None), (3, 1, None), (4, 0, "x"), (6, 0, "a"), (6, 1, "a"), (None, 0, "a")]
    other = [(1, 0, "z"), (1, 1, "a"), (1, 2, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, None), (5, 0, "q"), (6, 0, "a"), (6, 5, "a"), (None, 0, "a")]
    kind = "k int, p int, v string"
    got = {r.k: tuple(r)[1:] for r in replay.packet_order(spark.createDataFrame(base, kind), spark.createDataFrame(other, kind), "k", "p", "v").collect() if r.k is not None}
    assert got == {1: (2, 3, 0, "kept"), 2: (2, 2, 0, "reordered"), 3: (2, 1, 1, "lost"), 4: (1, 0, 1, "lost"), 5: (0, 1, 0, "kept"), 6: (2, 2, 0, "kept")}


def test_rekeyed(spark):
    rows = [(1, [3, 1, 2], ["c", "a", "b"]), (2, [1, 4], ["a", "d"]), (3, [1, 9], ["a", "z"]), (4, [1], ["a", "b"]), (5, [], []), (6, None, []), (7, [1, 1], ["x", "y"]), (8, [2, None], ["b", "n"])]
    mapping = [(1, "m"), (2, "a"), (3, "z"), (4, "m"), (5, None), (1, "m"), (None, "q")]
    df = spark.createDataFrame(rows, "k int, ids array<int>, labels array<string>").repartition(3)
    got = {r.k: (r.state, r.ids, r.labels) for r in replay.rekeyed(df, "k", "ids", ["labels"], spark.createDataFrame(mapping, "old int, new string"), "old", "new").collect()}
    assert got[1] == ("ok", ["a", "m", "z"], ["b", "a", "c"]) and got[2] == ("merged", None, None) and got[3][0] == "unknown" and got[4][0] == "misaligned" and got[6][0] == "misaligned"
    assert got[5] == ("ok", [], []) and got[7] == ("ok", ["m", "m"], ["x", "y"]) and got[8][0] == "unknown" and len(got) == 8
    with pytest.raises(Exception, match="two new ones"):
        replay.rekeyed(df, "k", "ids", ["labels"], spark.createDataFrame([(1, "m"), (1, "n")], "old int, new string"), "old", "new").collect()


def test_decisions(spark):
    d = [(1, "go", "wrong_to_correct", 7, 8), (2, "go", "correct_to_wrong", 7, 8), (3, "go", "wrong_to_correct", 7, 8), (4, "stay", None, 7, 8), (5, "go", "wrong_to_correct", 7, 8), (6, None, None, 1, 2)]
    lists = [(1, 1, True), (1, 2, False), (2, 2, True), (3, 2, True), (3, 3, True), (4, 3, True), (6, 2, True)]
    out = replay.redecided(spark.createDataFrame(d, "key int, action string, change string, selected int, baseline int"), spark.createDataFrame(lists, "key int, rank int, rival boolean"), "key", "go", "stopped", 3)
    got = {r.key: (r.certificate, r.after_action, r.selected_after) for r in out.collect()}
    assert got == {1: ("decided", "go", 7), 2: ("decided", "stopped", 8), 3: ("refused", None, None), 4: ("untouched", "stay", 7), 5: ("decided", "go", 7), 6: ("untouched", None, 1)}
    assert tuple(replay.outcome(out).first()) == (3, 1, 2, 0, 1, 0)


def test_replayed_equals_a_full_run(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    kind = "row_id int, channel string, entity string, vector array<double>"
    old, queries = spark.createDataFrame(rows, kind), spark.createDataFrame([(1000 + i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(5)], "query_id int, vector array<double>")
    after = [r for r in rows if r[0] % 9] + [(5, "a", "new", [0.0] * 4)]
    after = [(*r[:3], [-x for x in r[3]]) if r[0] % 10 == 3 else r for r in after]
    new = spark.createDataFrame(after, kind)
    changed = old.where("row_id % 9 = 0 or row_id % 10 = 3").select("entity", "channel").union(new.where("entity = 'new'").select("entity", "channel"))
    got = replay.replayed(vector.entity_scores(queries, old), queries, new, changed)
    want = vector.ranked(vector.entity_scores(queries, new), ["query_id", "channel"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def boxes(rng, n, images):
    out = []
    for k in range(n):
        x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        out.append((rng.randrange(images), k, x, y, x + rng.choice([0.0, rng.uniform(0, 120)]), y + rng.uniform(0, 60)))
    return [*out, (0, 900, 5.0, 5.0, 1.0, 9.0), (0, 901, None, 0.0, 1.0, 1.0), (0, 902, 0.0, 0.0, 50.0, 50.0), (0, 903, 50.0, 50.0, 100.0, 100.0)]


def test_grid_meets_as_all_pairs_do(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 150, 3), boxes(rng, 150, 3)
    kind = "image int, key int, x1 double, y1 double, x2 double, y2 double"
    got = [tuple(r) for r in geometry.grid_pairs(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "image", 50.0).collect()]
    ok = lambda x: None not in x and x[2] <= x[4] and x[3] <= x[5]
    want = [(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and ok(x) and ok(y) and max(x[2], y[2]) <= min(x[4], y[4]) and max(x[3], y[3]) <= min(x[5], y[5])]
    assert sorted(got) == sorted(want) and len(got) < len(a) * len(b) / 5


def test_orphans(spark):
    kind = "image int, key int, x1 double, y1 double, x2 double, y2 double"
    labels = [(1, 1, 0.0, 100.0, 10.0, 110.0), (1, 2, 50.0, 100.0, 60.0, 110.0), (1, 3, 200.0, 0.0, 210.0, 5.0), (1, 4, 400.0, 100.0, 410.0, 110.0)]
    parents = [(1, 10, 0.0, 80.0, 10.0, 95.0), (1, 11, 50.0, 80.0, 60.0, 95.0), (1, 12, 52.0, 85.0, 60.0, 92.0), (1, 13, 400.0, 80.0, 410.0, 90.0), (2, 14, 200.0, -20.0, 210.0, 0.0)]
    targets = [(1, 20, 400.0, 80.0, 410.0, 109.0)]
    got = {r.key: (r.parent, r.state, r.y1, r.y2) for r in geometry.orphans(*(spark.createDataFrame(x, kind) for x in (labels, parents, targets)), "image").collect()}
    assert got == {1: (10, "adopted", 80.0, 110.0), 2: (None, "ambiguous_parent_beneath", None, None), 3: (None, "no_parent_beneath", None, None), 4: (13, "existing_target", 80.0, 110.0)}


def test_edges_of_members_that_hold_the_mark(spark):
    members = spark.createDataFrame([(1, "a#b"), (1, "c"), (1, "d"), (2, "c"), (1, None)], "g int, m string")
    edges = spark.createDataFrame([("c", "a#b"), ("a#b", "c"), ("c", "c"), (None, "c"), ("d", "x")], "x string, y string")
    assert sorted(map(tuple, governance.edges_admitted(members, "g", "m", edges).collect())) == [(1, 3, 1, False), (2, 0, 0, True)]
    with pytest.raises(Exception, match="hold a #"):
        governance.edges_admitted(members, "g", "m", spark.createDataFrame([("a#b#c",)], "pair string")).collect()
