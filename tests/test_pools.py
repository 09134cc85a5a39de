"""Pools, matches, rosters and rules on hand-made rows: ties, nulls, refusals."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation, geometry, pool, roster, rules


def test_candidates_that_only_control_or_supply_has(spark):
    rows = spark.createDataFrame([(1, "a", "c1", 2.0), (1, "b", "c1", 2.0), (1, "a", "c2", 1.0)], "p int, k string, c string, s double")
    extra = spark.createDataFrame([(1, "z"), (2, "y")], "p int, k string")
    got = {(r["p"], r["k"]): r for r in pool.channel_features(rows, "p", "k", "c", "s", ["c1", "c2"], extra.where("p = 1"), extra).collect()}
    assert got[1, "a"]["agreed"] and got[1, "b"]["c1_rr"] == 0.5 and got[1, "b"]["c2_present"] == 0.0
    assert got[1, "z"]["is_control"] and got[1, "z"]["n_channels"] == 0 and got[2, "y"]["in_supplied"] and not got[2, "y"]["is_control"]


def test_gallery_refuses_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert sorted((r["id"], r["origin"]) for r in roster.appended(old, old.union(spark.createDataFrame([(3, "c")], old.schema)), "id").collect()) == [(1, "parent"), (2, "parent"), (3, "added")]
    with pytest.raises(ValueError):
        roster.appended(old, spark.createDataFrame([(2, "b")], old.schema), "id")


def test_single_dominator_needs_to_be_one(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (2, "b", 2), (2, "c", 3)], "p int, k string, r int")
    beats = spark.createDataFrame([(1, "c", "a"), (2, "b", "a"), (2, "c", "a")], "p int, winner string, loser string").withColumnRenamed("p", "p")
    got = {(r["p"], r["k"]): r["new_rank"] for r in pool.single_dominator(rows, beats, "p", "k", "r").collect()}
    assert [got[1, k] for k in "abc"] == [2, 3, 1] and [got[2, k] for k in "abc"] == [1, 2, 3]


def test_cycles_and_budget(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "g string, i int")
    got = sorted((r["g"], r["step"], r["i"]) for r in roster.cycled(rows, "g", ["i"], 3).collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 1), ("b", 0, 7), ("b", 1, 7), ("b", 2, 7)]
    states = [r["state"] for r in roster.within_budget(rows, "g", ["i"], F.col("i") != 7, 1).orderBy("g", "i").collect()]
    assert states == ["tried", "over_budget", "not_eligible"]


def test_repairs_keep_rows_and_count(spark):
    rows = spark.createDataFrame([("blue blue sky",), ("no blue",), (None,)], "t string")
    got = {r["t"]: (r["repaired"], r["edits"]) for r in rules.repaired(rows, "t", [("letter", "blue", "bleu")], "^no ").collect()}
    assert got == {"blue blue sky": ("bleu bleu sky", "letter:2"), "no blue": ("no blue", ""), None: ("", "")}


def test_nested_values_at_depth(spark):
    rows = spark.createDataFrame([(1, '{"k": 1, "a": {"k": "x", "b": {"k": null}}}'), (2, "no json"), (3, None)], "id int, d string")
    got = {(r["id"], r["path"], r["value"]) for r in evaluation.nested_values(rows, "id", "d", "k").collect()}
    assert {(1, "k", "1"), (1, "a.k", "x")} <= got and all(r[0] == 1 for r in got)
    assert evaluation.scrubbed(rows.withColumn("took_ms", F.lit(1)), ["id", "d", "took_ms"], "_ms$").columns == ["id", "d"]


def test_fragments_and_regions(spark):
    rows = spark.createDataFrame([(1, 1, 0.95, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.5, 1.0, 1.0, 5.0, 5.0), (1, 3, 0.99, 1.0, 1.0, 5.0, 5.0), (2, 1, 0.5, 0.0, 0.0, 1.0, 1.0)], "image int, key int, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["image"], r["key"]): (r["state"], r["enclosing_key"]) for r in geometry.nested(rows, "image").collect()}
    assert got == {(1, 1): ("kept", None), (1, 2): ("fragment", 1), (1, 3): ("kept", None), (2, 1): ("kept", None)}
    found = {r["image"]: (r["key"], r["reason"]) for r in geometry.roi_match(rows, "image", tuple(F.lit(x) for x in (1.0, 1.0, 5.0, 5.0))).collect()}
    assert found == {1: (None, "tied_overlap"), 2: (None, "no_overlap")}
