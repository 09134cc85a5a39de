"""Boxes of images: suppression, matching, association. Rows meet only within an image.

The greedy operators gather the boxes of an image, which a detector bounds, into one sorted array and fold over it in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx

CORNERS = ("x1", "y1", "x2", "y2")


def _corners(b: Column) -> bx.Box:
    return tuple(b[c] for c in CORNERS)


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(bx.iou(_corners(a), _corners(b)), F.lit(0.0))


def _gathered(rows: DataFrame, image: str, name: str, *order: Column) -> DataFrame:
    """(image, name): the boxes of an image as one array of structs, in the order of the leading fields."""
    return rows.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(*order, *CORNERS))).alias(name))


def _best_first(score: str) -> Column:
    """Ascending where scores descend; a null score comes last."""
    return (-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("down")


def suppressed(rows: DataFrame, image: str, key: str, score: str, limit: float) -> DataFrame:
    """(image, key) of boxes kept by score-ordered suppression: a box stays if its IoU with every kept one is at most `limit`. Ties go to the smaller key."""

    def keep(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: _overlap(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b)))

    pool = _gathered(rows, image, "pool", _best_first(score), F.col(key).alias("key"))
    kept = F.aggregate("pool", F.slice("pool", 1, 0), keep)
    return pool.select(image, F.explode(F.transform(kept, lambda b: b["key"])).alias(key))


def matched(found: DataFrame, truth: DataFrame, image: str, limit: float = 0.5) -> DataFrame:
    """(image, key, truth_key): detections, best score first, each take the free truth of largest IoU of at least `limit`. Ties go to the smaller key."""
    pairs = f"array<struct<key:{found.schema['key'].dataType.simpleString()},truth_key:{truth.schema['key'].dataType.simpleString()}>>"

    def take(state: Column, b: Column) -> Column:
        free = state["free"]
        overlaps = F.transform(free, lambda t: _overlap(b, t))
        most = F.array_max(overlaps)
        at = F.array_position(overlaps, most).cast("int")
        left = F.concat(F.slice(free, 1, at - 1), F.slice(free, at + 1, F.size(free)))
        new = F.struct(b["key"].alias("key"), F.element_at(free, at)["key"].alias("truth_key"))
        return F.when(most >= limit, F.struct(left.alias("free"), F.concat(state["taken"], F.array(new)).alias("taken"))).otherwise(state)

    both = _gathered(found, image, "found", _best_first("score"), F.col("key")).join(_gathered(truth, image, "free", F.col("key")), image)
    start = F.struct("free", F.array().cast(pairs).alias("taken"))
    taken = F.aggregate("found", start, take, lambda state: state["taken"])
    return both.select(image, F.inline(taken))


def associated(parents: DataFrame, labels: DataFrame, image: str, share: float = 0.8) -> DataFrame:
    """(image, label_key, n_parents, parent_key, state): a label belongs to the one parent that holds its centre and `share` of its area.

    state: one, orphan or ambiguous; parent_key only where there is one.
    """
    p = parents.select(image, F.col("key").alias("parent_key"), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    lab = labels.select(image, F.col("key").alias("label_key"), *(F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = (bx.share_inside(bx.box("l_"), bx.box("p_")) >= share) & bx.centre_inside(bx.box("l_"), bx.box("p_"))
    hits = lab.join(p, image).where(inside).groupBy(image, "label_key").agg(F.count("*").alias("n"), F.min("parent_key").alias("parent"))
    out = lab.select(image, "label_key").join(hits, [image, "label_key"], "left").withColumn("n_parents", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n_parents") == 0, "orphan").when(F.col("n_parents") == 1, "one").otherwise("ambiguous")
    return out.select(image, "label_key", "n_parents", F.when(F.col("n_parents") == 1, F.col("parent")).alias("parent_key"), state.alias("state"))


def envelope(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, x1, y1, x2, y2): the union box."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def primary(rows: DataFrame, image: str, key: str, width: Column, height: Column) -> DataFrame:
    """(image, key, n, area_share): the default target, nearest to the frame's centre, then larger, then smaller key."""
    b = bx.box()
    cx, cy = (b[0] + b[2]) / 2 - width / 2, (b[1] + b[3]) / 2 - height / 2
    w = Window.partitionBy(image).orderBy(F.round(cx * cx + cy * cy, 6), F.desc(F.round(bx.area(b), 6)), key)
    n = F.count("*").over(Window.partitionBy(image))
    return rows.withColumns({"r__": F.row_number().over(w), "n": n, "area_share": F.round(bx.area(b) / (width * height), 9)}).where("r__ = 1").select(image, key, "n", "area_share")




def _pairs(rows: DataFrame, image: str, payload: list[str]) -> DataFrame:
    """Every box with every other of its image, as a_... and b_... columns."""
    side = lambda x: rows.select(image, *(F.col(c).alias(f"{x}{c}") for c in payload))
    return side("a_").join(side("b_"), image).where("a_key != b_key")


def nested(rows: DataFrame, image: str, inside: float = 0.95, times: float = 12.0, sure: float = 0.9) -> DataFrame:
    """(image, key, state, enclosing_key): a box is a fragment if a larger one of at least `sure` and of no smaller score holds `inside` of its area and is at most `times` as large; the largest such is named.

    Fragments stay as rows. A box that is a fragment itself still encloses.
    """
    p = _pairs(rows, image, ["key", "score", *CORNERS])
    a, b = bx.box("a_"), bx.box("b_")
    held = (bx.share_inside(a, b) >= inside) & (bx.area(b) > bx.area(a)) & (bx.area(b) <= times * bx.area(a)) & (F.col("b_score") >= F.greatest(F.lit(sure), F.col("a_score")))
    parent = p.where(held).groupBy(image, F.col("a_key").alias("key")).agg(F.max(F.struct(bx.area(b).alias("s"), (-F.col("b_key")).alias("k"))).alias("m")).select(image, "key", (-F.col("m.k")).alias("enclosing_key"))
    out = rows.select(image, "key").join(parent, [image, "key"], "left")
    return out.select(image, "key", F.when(F.col("enclosing_key").isNull(), "kept").otherwise("fragment").alias("state"), "enclosing_key")


def roi_match(rows: DataFrame, image: str, roi: bx.Box, sure: float = 0.9) -> DataFrame:
    """(image, key, overlap, reason, addressed): the box of the largest overlap with a region; reason: unique_maximum, tied_overlap (within 1e-12) or no_overlap, with a key only for the first.

    addressed: its overlap is at least `sure` and the next one's is not.
    """
    scored = rows.withColumn("o", bx.iou(bx.box(), roi))
    w = Window.partitionBy(image).orderBy(F.desc("o"), "key")
    first = scored.withColumns({"r": F.row_number().over(w), "next": F.lead("o").over(w)}).where("r = 1")
    reason = F.when(F.col("o") <= 0, "no_overlap").when(F.coalesce(F.col("o") - F.col("next") <= 1e-12, F.lit(False)), "tied_overlap").otherwise("unique_maximum")
    out = first.withColumn("reason", reason)
    only = F.col("reason") == "unique_maximum"
    return out.select(image, F.when(only, F.col("key")).alias("key"), F.col("o").alias("overlap"), "reason", (only & (F.col("o") >= sure) & (F.coalesce("next", F.lit(0.0)) < sure)).alias("addressed"))


def recovered(rows: DataFrame, found: DataFrame, image: str, width: Column, height: Column, least: float = 0.1, growth: float = 1.1) -> DataFrame:
    """(image, key, grew, x1..y2): a box and all found ones that overlap it by `least` in one, within the frame; the box itself where that is less than `growth` times as large."""
    own = rows.select(image, "key", *(F.col(c).alias(f"a_{c}") for c in CORNERS))
    other = found.select(image, *(F.col(c).alias(f"b_{c}") for c in CORNERS))
    near = own.join(other, image).where(bx.iou(bx.box("a_"), bx.box("b_")) >= least)
    spans = near.groupBy(image, "key").agg(F.min("b_x1").alias("b_x1"), F.min("b_y1").alias("b_y1"), F.max("b_x2").alias("b_x2"), F.max("b_y2").alias("b_y2"))
    out = own.join(spans, [image, "key"], "left")
    new = [F.greatest(F.least("a_x1", F.coalesce("b_x1", "a_x1")), F.lit(0.0)), F.greatest(F.least("a_y1", F.coalesce("b_y1", "a_y1")), F.lit(0.0)), F.least(F.greatest("a_x2", F.coalesce("b_x2", "a_x2")), width), F.least(F.greatest("a_y2", F.coalesce("b_y2", "a_y2")), height)]
    grew = bx.area(tuple(new)) >= growth * bx.area(bx.box("a_"))
    return out.withColumn("grew", grew).select(image, "key", "grew", *(F.when(F.col("grew"), n).otherwise(F.col(f"a_{c}")).alias(c) for n, c in zip(new, CORNERS, strict=True)))


def owned_labels(rows: DataFrame, image: str, parent: str, limit: float = 0.65) -> DataFrame:
    """(image, key) of labels that stay with their parent: in the order of scores a label goes if one that stays under another parent overlaps it by `limit`. Ties go to the smaller key."""
    same = rows.schema[parent].dataType

    def keep(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["parent"] != b["parent"]) & (_overlap(k, b) >= limit)), kept).otherwise(F.concat(kept, F.array(b)))

    pool = _gathered(rows, image, "pool", _best_first("score"), F.col("key").alias("key"), F.col(parent).cast(same).alias("parent"))
    kept = F.aggregate("pool", F.slice("pool", 1, 0), keep)
    return pool.select(image, F.explode(F.transform(kept, lambda b: b["key"])).alias("key"))


def best_region(rows: DataFrame, image: str, priority: Column, clear: float = 0.04) -> DataFrame:
    """(image, key, n, state): the region of the largest priority; ambiguous, without a key, if the next one's is less than `clear` below."""
    w = Window.partitionBy(image).orderBy(F.desc("p__"), "key")
    first = rows.withColumn("p__", priority).withColumns({"r": F.row_number().over(w), "next": F.lead("p__").over(w), "n": F.count("*").over(Window.partitionBy(image))}).where("r = 1")
    clear_ = F.coalesce(F.col("p__") - F.col("next") >= clear, F.lit(True))
    return first.select(image, F.when(clear_, F.col("key")).alias("key"), "n", F.when(clear_, "chosen").otherwise("ambiguous").alias("state"))


def grid_pairs(a: DataFrame, b: DataFrame, by: str, cell: float) -> DataFrame:
    """(by, a, b): keys of boxes of one image that meet, edges included, each pair once. a, b: (by, key, x1, y1, x2, y2).

    Boxes are dealt to the cells of a grid that they touch, and meet there; a pair counts in the cell of the lower corner of what they share. Boxes without a corner or with crossed ones meet none.
    """
    at = lambda x: F.floor(x / cell).cast("long")
    ok = "x1 <= x2 and y1 <= y2"

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        cells = rows.where(ok).withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.col("x2"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.col("y2")))))
        return cells.select(by, "cx", "cy", F.col("key").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("x1", "y1", "x2", "y2")))

    both = dealt(a, "a").join(dealt(b, "b"), [by, "cx", "cy"])
    low = {c: F.greatest(f"a_{c}", f"b_{c}") for c in ("x1", "y1")}
    meets = (low["x1"] <= F.least("a_x2", "b_x2")) & (low["y1"] <= F.least("a_y2", "b_y2"))
    return both.where(meets & (at(low["x1"]) == F.col("cx")) & (at(low["y1"]) == F.col("cy"))).select(by, "a", "b")


def orphans(labels: DataFrame, parents: DataFrame, targets: DataFrame, by: str, most_gap: float = 10.0, overlap: float = 0.5, same: float = 0.5, cell: float = 50.0) -> DataFrame:
    """(by, key, parent, state, x1, y1, x2, y2) of labels without a parent: the one parent beneath, and the envelope of both, or why there is none.

    labels, parents, targets: (by, key, x1, y1, x2, y2), y growing downwards from a parent to the label above it as in beneath(): a parent ends at most `most_gap` before the label begins and covers at least `overlap` of its width. state: adopted; no_parent_beneath;
    ambiguous_parent_beneath, if there are several; existing_target, if a target's IoU with the envelope is above `same`. Candidates come from a grid, not from all boxes of an image.
    """
    below = labels.select(by, "key", "x1", (F.col("y1") - most_gap).alias("y1"), "x2", F.col("y1").alias("y2"))
    pairs = grid_pairs(below, parents, by, cell)
    box = lambda rows, name: rows.select(by, F.col("key").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("x1", "y1", "x2", "y2")))
    near = pairs.join(box(labels, "a"), [by, "a"]).join(box(parents, "b"), [by, "b"])
    gap, width = F.col("a_y1") - F.col("b_y2"), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    near = near.where(gap.between(0, most_gap) & (width >= overlap * (F.col("a_x2") - F.col("a_x1"))))
    union = [F.least("a_x1", "b_x1").alias("x1"), F.least("a_y1", "b_y1").alias("y1"), F.greatest("a_x2", "b_x2").alias("x2"), F.greatest("a_y2", "b_y2").alias("y2")]
    one = near.groupBy(by, F.col("a").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("b").alias("parent"), *union)).alias("m"))
    held = labels.select(by, "key").join(one, [by, "key"], "left").select(by, "key", "n", "m.*")
    alone = held.where("n = 1").select(by, "key", "x1", "y1", "x2", "y2")
    hits = grid_pairs(alone, targets, by, cell).join(box(alone, "a"), [by, "a"]).join(box(targets, "b"), [by, "b"])
    area = lambda n: (F.col(f"{n}_x2") - F.col(f"{n}_x1")) * (F.col(f"{n}_y2") - F.col(f"{n}_y1"))
    shared = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    taken = hits.where(shared > same * (area("a") + area("b") - shared)).select(by, F.col("a").alias("key")).distinct().withColumn("taken", F.lit(True))
    out = held.join(taken, [by, "key"], "left")
    state = F.when(F.col("n").isNull(), "no_parent_beneath").when(F.col("n") > 1, "ambiguous_parent_beneath").when(F.col("taken"), "existing_target").otherwise("adopted")
    mine = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)
    return out.select(by, "key", mine("parent"), state.alias("state"), *(mine(c) for c in ("x1", "y1", "x2", "y2")))
