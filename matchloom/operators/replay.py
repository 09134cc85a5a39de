"""Comparing and replaying stored runs: packets kept in order, decisions under a new rule with a certificate, rows under new identities, scores after some vectors changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import sided
from .vector import entity_scores, ranked


def packet_order(base: DataFrame, other: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, n_base, n_other, n_lost, state) of every packet of base or other: kept if its rows stand in the other packet in the same order, others between them allowed; reordered if they are all there
    otherwise; lost if some are not. A null value is a value; repeats must be there as often; rows of one position are in the order of their values; a packet that only one side has is empty in the other.
    """
    side = lambda rows, name: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: F.struct(x[value].alias("v"))).alias(name))
    empty = lambda c, like: F.coalesce(F.col(c), F.filter(like, lambda x: F.lit(False)))
    both = side(base, "a").join(side(other, "b"), key, "full")
    both = both.select(key, empty("a", F.coalesce("a", "b")).alias("a"), empty("b", F.coalesce("a", "b")).alias("b"))
    # one pass over the other packet: how many of the base rows have been met in their order
    met = F.aggregate("b", F.lit(0), lambda n, x: F.when((n < F.size("a")) & F.get("a", n).eqNullSafe(x), n + 1).otherwise(n))
    times = lambda xs, v: F.size(F.filter(xs, lambda y: y.eqNullSafe(v)))
    lost = F.aggregate(F.array_distinct("a"), F.lit(0), lambda n, v: n + F.greatest(F.lit(0), times(F.col("a"), v) - times(F.col("b"), v)))
    state = F.when(met == F.size("a"), "kept").when(lost == 0, "reordered").otherwise("lost")
    return both.select(key, F.size("a").alias("n_base"), F.size("b").alias("n_other"), lost.alias("n_lost"), state.alias("state"))


def rekeyed(rows: DataFrame, key: str, ids: str, aligned: list[str], mapping: DataFrame, old: str, new: str) -> DataFrame:
    """(key, state, ids, *aligned) of nested rows under a new identity: ids are looked up in the mapping (old, new), sorted, and the aligned arrays follow them.

    state is ok, merged if two different ids of one row become one, unknown if an id has no new one, misaligned if the arrays of a row differ in length or are null; all but ok rows have null arrays. The same id twice in a row stays
    twice. An old id must have one new one: it raises if the mapping says two.
    """
    known = mapping.where(F.col(old).isNotNull()).select(F.col(old).alias("old__"), F.col(new).alias("new__")).distinct()
    known = known.groupBy("old__").agg(F.min("new__").alias("new__"), F.count("new__").alias("n__"))
    known = known.withColumn("new__", F.when(F.col("n__") > 1, F.raise_error(F.lit("an id has two new ones"))).otherwise(F.col("new__"))).drop("n__")
    whole = F.lit(True)
    for a in aligned:
        whole = whole & F.coalesce(F.size(a) == F.size(ids), F.lit(False))
    own = rows.select(key, F.col(ids).alias("ids__"), *aligned, (F.col(ids).isNotNull() & whole).alias("whole__"))
    # an array that cannot be aligned is not taken apart
    each = own.select(key, "whole__", F.posexplode_outer(F.when(F.col("whole__"), F.arrays_zip(F.col("ids__").alias("ids__"), *aligned))).alias("at__", "z__"))
    each = each.select(key, "whole__", "at__", F.col("z__.ids__").alias("old__"), *(F.col(f"z__.{a}").alias(a) for a in aligned)).join(sided(known), "old__", "left")
    item = F.when(F.col("at__").isNotNull(), F.struct(F.col("new__"), "at__", *aligned, "old__"))
    # ids are gathered once and told apart in their row
    held = each.groupBy(key).agg(F.min("whole__").alias("whole__"), F.array_sort(F.collect_list(item)).alias("items"))
    held = held.withColumns({
        "gone__": F.size(F.filter("items", lambda x: x["new__"].isNull())), "n_old": F.size(F.array_distinct(F.array_compact(F.transform("items", lambda x: x["old__"])))),
        "n_new": F.size(F.array_distinct(F.array_compact(F.transform("items", lambda x: x["new__"])))),
    })
    state = F.when(~F.col("whole__"), "misaligned").when(F.col("gone__") > 0, "unknown").when(F.col("n_new") < F.col("n_old"), "merged").otherwise("ok")
    out = held.withColumn("state", state)
    ok = F.col("state") == "ok"
    return out.select(key, "state", F.when(ok, F.transform("items", lambda x: x["new__"])).alias(ids), *(F.when(ok, _field(a)).alias(a) for a in aligned))


def _field(name: str):
    return F.transform("items", lambda x: x[name])


def redecided(decisions: DataFrame, lists: DataFrame, key: str, acting: str, blocked: str, k: int) -> DataFrame:
    """decisions (key, action, change, selected, baseline) with after_action, change_after, selected_after and certificate, under the rule that a rival blocks an action.

    lists: (key, rank from 1, rival), cut at k. Only decisions of the action `acting` can change: a rival at rank 2 or more makes them `blocked`, with the baseline selected and no change. refused: the last row of a list
    of k is a rival itself, so that one behind the cut could be too, and nothing is decided (nulls); untouched: another action; decided: all else. Null rivals are none; a decision without a list has no rivals.
    """
    seen = lists.groupBy(key).agg(F.max(F.coalesce("rival", F.lit(False)) & (F.col("rank") > 1)).alias("rivals"), F.max(F.coalesce("rival", F.lit(False)) & (F.col("rank") >= k)).alias("cut"))
    out = decisions.join(seen, key, "left")
    certificate = F.when(~F.col("action").eqNullSafe(F.lit(acting)), "untouched").when(F.col("cut"), "refused").otherwise("decided")
    out = out.withColumn("certificate", certificate)
    stops = (F.col("certificate") == "decided") & F.coalesce("rivals", F.lit(False))
    after = lambda now, then: F.when(F.col("certificate") == "refused", None).when(stops, then).otherwise(F.col(now))
    return out.withColumns({"after_action": after("action", F.lit(blocked)), "change_after": after("change", None), "selected_after": after("selected", F.col("baseline"))}).drop("rivals", "cut")


def outcome(decided: DataFrame, fixed: str = "wrong_to_correct", broken: str = "correct_to_wrong") -> DataFrame:
    """One row of counts over redecided rows: decided and refused, fixes kept and lost, regressions removed and left."""
    own = F.col("certificate") == "decided"
    count = lambda before, same: F.count_if(own & (F.col("change") == before) & (F.col("change_after").eqNullSafe(F.col("change")) == same))
    return decided.agg(
        F.count_if(own).alias("n_decided"), F.count_if(F.col("certificate") == "refused").alias("n_refused"), count(fixed, True).alias("fixes_kept"), count(fixed, False).alias("fixes_lost"),
        count(broken, False).alias("regressions_removed"), count(broken, True).alias("regressions_left"),
    )


def replayed(stored: DataFrame, queries: DataFrame, gallery: DataFrame, changed: DataFrame) -> DataFrame:
    """Ranked scores after some rows of the gallery changed: those of entities without a changed row are the stored ones, the others are made again, and both are ranked together.

    stored: entity_scores of the old gallery; gallery: the new one; changed: (entity, channel) of rows that were added, removed or changed, with their old and their new entity. Null entities are compared as values.
    """
    touched = changed.select(F.col("entity").alias("e__"), F.col("channel").alias("c__")).distinct()
    same = F.col("entity").eqNullSafe(F.col("e__")) & F.col("channel").eqNullSafe(F.col("c__"))
    kept = stored.join(touched, same, "left_anti")
    again = entity_scores(queries, gallery.join(touched, same, "left_semi"))
    return ranked(kept.unionByName(again), ["query_id", "channel"])
