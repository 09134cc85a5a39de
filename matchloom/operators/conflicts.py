"""Pairs that a known conflict does not let tell apart: notes on rankings, references that contradict their card, presentations of blocked pairs; donors for rows that were taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, sided


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(x, y, conflict) of pairs (a, b, conflict), in both orders; pairs with a null or of one member are none."""
    known = pairs.where("a is not null and b is not null and a != b")
    return known.select(F.col("a").alias("x"), F.col("b").alias("y"), "conflict").union(known.select(F.col("b").alias("x"), F.col("a").alias("y"), "conflict")).distinct()


def annotated(candidates: DataFrame, pairs: DataFrame, values: DataFrame, observed: DataFrame, by: str, key: str, top_k: int) -> DataFrame:
    """(by, top1, members, conflicts, selectable, status) of rankings whose first candidate is in conflict with another of the first top_k. The order of candidates stays as it is.

    candidates: (by, key, rank), null keys are passed over; pairs: (a, b, conflict); values: (key, value) of cards; observed: (by, value). selectable: the one member, first candidate or partner, whose card value was observed, null
    if none or several are. members and conflicts are sorted lists. A key at several ranks counts at its best.
    """
    # what is known of a ranking is one row of it, dealt by `by` alone; pairs and values go to it where they are few
    top = candidates.where(F.col(by).isNotNull() & F.col(key).isNotNull() & (F.col("rank") <= top_k)).groupBy(by).agg(F.min(F.struct("rank", key)).alias("f"), F.collect_set(key).alias("keys__"))
    met = top.select(by, F.col(f"f.{key}").alias("top1"), F.explode("keys__").alias("y")).join(sided(checkpointed(_both_ways(pairs).select(F.col("x").alias("top1"), "y", "conflict"))), ["top1", "y"])
    noted = met.groupBy(by, "top1").agg(F.array_sort(F.collect_set("conflict")).alias("conflicts"), F.collect_set("y").alias("partners"))
    group = noted.select(by, "top1", "conflicts", F.array_sort(F.array_append("partners", F.col("top1"))).alias("members"))
    seen = observed.where(F.col("value").isNotNull()).groupBy(by).agg(F.collect_set("value").alias("seen__"))
    told = group.select(by, F.explode("members").alias(key)).join(sided(checkpointed(values.select(key, "value").distinct())), key)
    told = told.groupBy(by).agg(F.collect_list(F.struct(F.col(key).alias("k"), "value")).alias("told__"))
    own = F.array_distinct(F.transform(F.filter("told__", lambda x: F.array_contains("seen__", x["value"])), lambda x: x["k"]))
    hit = told.join(seen, by).select(by, F.size(own).alias("n"), F.array_min(own).alias("one"))
    out = group.join(hit, by, "left").withColumn("selectable", F.when(F.col("n") == 1, F.col("one")))
    status = F.when(F.col("selectable").isNotNull(), "conflict_resolved_by_text").otherwise("ambiguous_reference_conflict")
    return out.select(by, "top1", "members", "conflicts", "selectable", status.alias("status"))


def contradicting(references: DataFrame, photos: DataFrame, photo: str, card: str) -> DataFrame:
    """references with conflict, those alone whose photo contradicts the card that they are bound to; rows of the same photo under other cards stay out. photos: (photo, card, conflict)."""
    return references.join(photos.select(photo, card, "conflict").distinct(), [photo, card])


def presentations(steps: DataFrame, pairs: DataFrame, last: int | None = None) -> DataFrame:
    """(kind, n): how often a schedule shows a blocked pair when its steps are replayed in a cycle up to step `last`, itself included; one round if none is given.

    steps: (step, kind, x, y), step from 0, as many as the cycle has; x and y in either order. Kinds without a blocked pair have no row. Rows with a null member are no pairs.
    """
    cycle = steps.agg((F.max("step") + 1).alias("cycle"))
    end = F.col("cycle") - 1 if last is None else F.lit(last)
    shown = F.greatest(F.lit(0), F.floor((end - F.col("step")) / F.col("cycle")) + 1)
    hit = steps.join(_both_ways(pairs).select("x", "y").distinct(), ["x", "y"]).join(F.broadcast(cycle))  # one row
    return hit.groupBy("kind").agg(F.sum(shown).cast("long").alias("n")).where("n > 0")


def donors(rows: DataFrame, wanting: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """(key, donor): for each wanting row (key, *by) the first row of its groups, null where there is none. rows: (key, *by, *order), those that may give; null groups match null groups.

    One donor a group is found first, so that a group's wanting rows do not meet all its rows. A row is no donor of itself: where it is the first, the second gives.
    """
    two = _two(rows, key, by, order)
    same = [wanting[c].eqNullSafe(two[f"{c}__"]) for c in by]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = wanting.join(two, cond, "left")
    return out.select(wanting[key], F.when(F.col("first__").eqNullSafe(wanting[key]), F.col("second__")).otherwise(F.col("first__")).alias("donor"))


def _two(rows: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """(*by, first__, second__): the first two keys of each group, by two aggregations that are combined before their shuffle."""
    o = F.struct(*order, key)
    groups = [F.col(c).alias(f"{c}__") for c in by]
    own = rows.select(*groups, o.alias("o__"))
    # min_by's pair: the least, and the least of what is left when it is taken out
    first = own.groupBy(*(f"{c}__" for c in by)).agg(F.min("o__").alias("a"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}__").eqNullSafe(F.col(f"r.{c}__"))
    rest = own.alias("l").join(first.alias("r"), same).where(F.col("o__") > F.col("a")).groupBy(*(F.col(f"r.{c}__") for c in by)).agg(F.min("o__").alias("b"))
    again = F.lit(True)
    for c in by:
        again = again & F.col(f"f.{c}__").eqNullSafe(F.col(f"s.{c}__"))
    out = first.alias("f").join(rest.alias("s"), again, "left")
    return out.select(*(F.col(f"f.{c}__") for c in by), F.col(f"a.{key}").alias("first__"), F.col(f"b.{key}").alias("second__"))
