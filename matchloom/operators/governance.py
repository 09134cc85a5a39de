"""Which rows may be used: leakage audits, lineage, grouped splits, masks, schedules, first-wins unions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import hash_share, pair_key

from .graph import MOST_BROADCAST, ROWS_A_TASK, checkpointed, running


def audit(rows: DataFrame, key: str, pools: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """rows with reasons (sorted, comma-joined) and allowed: a row is denied by every pool that one of its keys meets.

    pools: (reason, pool, column of the pool, column of rows). Each is one equi-join; reasons are gathered per row key.
    """
    found = None
    for reason, pool, theirs, ours in pools:
        hit = rows.where(F.col(ours).isNotNull()).join(pool.select(F.col(theirs).alias("k__")).distinct(), F.col(ours) == F.col("k__"), "left_semi").select(key, F.lit(reason).alias("reason"))
        found = hit if found is None else found.union(hit)
    why = found.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return rows.join(why, key, "left").withColumns({"reasons": F.coalesce("reasons", F.lit("")), "allowed": F.col("reasons").isNull()})


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node): everything reachable from the roots along (parent, child) edges, roots included. Cycles end the walk."""
    edges = checkpointed(edges.where(F.col("parent").isNotNull()).select("parent", "child"))
    side = lambda df, n: F.broadcast(df) if n <= MOST_BROADCAST else df.hint("merge")
    # every round is written once and read by few tasks while it is small; what was seen is the rounds together
    front, n = _compact(roots.select("node").distinct())
    seen, total = front, n
    for _ in range(most_rounds):
        new = edges.join(side(front.select(F.col("node").alias("parent")), n), "parent").select(F.col("child").alias("node")).distinct()
        front, n = _compact(new.join(side(seen, total), "node", "left_anti"))
        if n == 0:
            return seen
        seen, total = seen.union(front), total + n
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def _compact(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, written, read by one task if they are few, and their number."""
    rows = checkpointed(rows)
    n = rows.count()
    return (rows.coalesce(1) if n <= ROWS_A_TASK else rows), n


def grouped_split(groups: DataFrame, group: str, size: str, salt: str, share: float, overshoot: float = 1.25) -> DataFrame:
    """(group, role): groups in the order of a salted hash go to 'selection' until it has `share` of all rows; one that would pass `overshoot` times that is skipped.

    A group is skipped only if it has more than overshoot - 1 of what is wanted; of such groups there are few, whatever the number of rows, and the driver walks over them alone. All
    others are taken until there are enough, which running sums over ranges of hashes tell.
    """
    own = groups.select(F.col(group), F.col(size).cast("long").alias("n__"), F.sha2(F.concat(F.lit(salt), F.col(group).cast("string")), 256).alias("h__"))
    total = own.agg(F.sum("n__")).first()[0] or 0
    want = share * total
    placed = running(own.withColumn("small__", F.when(F.col("n__") > (overshoot - 1) * want, 0).otherwise(F.col("n__"))), ["h__"], "small__")
    taken = []  # hash, rows
    for r in placed.where(F.col("n__") > (overshoot - 1) * want).orderBy("h__").collect():  # 1 / (share * (overshoot - 1)) groups at most
        before = r["before"] + sum(n for _, n in taken)
        if before < want and before + r["n__"] <= overshoot * want:
            taken.append((r["h__"], r["n__"]))
    before = F.col("before")
    for h, n in taken:
        before = before + F.when(F.col("h__") > h, n).otherwise(0)
    chosen = F.when(F.col("n__") > (overshoot - 1) * want, F.col("h__").isin([h for h, _ in taken])).otherwise(before < want)
    return placed.select(group, F.when(chosen, "selection").otherwise("fit").alias("role"))


def share_split(rows: DataFrame, group: str, salt: str, share: float) -> DataFrame:
    """rows with role by the hash of their group alone: no group is cut, no order is needed."""
    return rows.withColumn("role", F.when(hash_share(salt, F.col(group)) < share, "selection").otherwise("fit"))


def masked(rows: DataFrame, truth: Column, candidate: Column, pairs: DataFrame) -> DataFrame:
    """rows with `masked`: the pair (truth, candidate), in either order, is in pairs (column pair). The truth itself is never masked."""
    keyed = rows.withColumn("pair__", pair_key(truth, candidate))
    hit = pairs.select(F.col("pair").alias("pair__"), F.lit(True).alias("hit__")).distinct()
    return keyed.join(hit, "pair__", "left").withColumn("masked", F.coalesce("hit__", F.lit(False)) & (truth != candidate)).drop("pair__", "hit__")


def edges_admitted(members: DataFrame, group: str, member: str, edges: DataFrame) -> DataFrame:
    """(group, pairs, admitted, all_admitted): pairs of members of a group, and how many are edges. Counts alone: no pair is listed twice.

    edges: columns x and y, in either order; or a column pair of both joined by one #, in which a member that holds a # itself cannot be told and is refused.
    """
    a, b = members.select(group, F.col(member).alias("a")).distinct(), members.select(group, F.col(member).alias("b")).distinct()
    n = members.groupBy(group).agg(F.countDistinct(member).alias("n")).select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    if {"x", "y"} <= set(edges.columns):
        ends = edges.select(F.least(F.col("x").cast("string"), F.col("y").cast("string")).alias("x"), F.greatest(F.col("x").cast("string"), F.col("y").cast("string")).alias("y"))
        ends = ends.where("x != y").distinct()
    else:
        parts = F.split("pair", "#")
        whole = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error("a pair of members that hold a #: give the edges as x and y"))
        ends = edges.where(F.col("pair").isNotNull()).select(whole[0].alias("x"), whole[1].alias("y")).distinct()
    hit = ends.join(a, ends["x"] == a["a"].cast("string")).join(b, [group]).where(F.col("y") == F.col("b").cast("string")).groupBy(group).agg(F.count("*").alias("admitted"))
    return n.join(hit, group, "left").select(group, "pairs", F.coalesce("admitted", F.lit(0)).alias("admitted"), (F.coalesce("admitted", F.lit(0)) == F.col("pairs")).alias("all_admitted"))


#: Hashes of a side that a task of nearest_hash compares.
HASH_BLOCK = 8192


def nearest_hash(rows: DataFrame, refs: DataFrame, on: str, a: str, b: str) -> DataFrame:
    """rows with min_bits: the least number of differing bits to a reference of the same `on` value; null without one.

    Different hashes alone are compared, block against block, and a task returns one number a hash: no pair leaves it, and a large value of `on` is many tasks.
    """
    left, right = rows.select(on, a).where(F.col(on).isNotNull() & F.col(a).isNotNull()).distinct(), refs.select(on, b).where(F.col(on).isNotNull() & F.col(b).isNotNull()).distinct()
    blocks = lambda side, name: side.groupBy(on).agg(F.ceil(F.count("*") / HASH_BLOCK).cast("int").alias(name))
    grid = blocks(left, "p").join(blocks(right, "q"), on)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(grid, on).select(on, F.col(a).alias("a"), place(a, "p").alias("g"), every("q").alias("h")).groupBy(on, "g", "h").agg(F.collect_list("a").alias("xs"))
    two = right.join(grid, on).select(on, F.col(b).alias("b"), every("p").alias("g"), place(b, "q").alias("h")).groupBy(on, "g", "h").agg(F.collect_list("b").alias("ys"))
    kind = rows.schema[on].dataType.simpleString()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, xs, ys in zip(pdf[on], pdf["xs"], pdf["ys"], strict=True):
                y = np.asarray(ys, np.int64)
                least = np.concatenate([np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)).min(axis=1) for x in np.array_split(np.asarray(xs, np.int64), max(1, len(xs) // 512))])
                yield pd.DataFrame({on: key, a: xs, "bits": least.astype(np.int32)})

    found = one.join(two, [on, "g", "h"]).select(on, "xs", "ys").mapInPandas(task, f"{on} {kind}, {a} long, bits int")
    best = found.groupBy(on, a).agg(F.min("bits").alias("min_bits"))
    return rows.join(best, [on, a], "left").select(*rows.columns, "min_bits")


def batches(rows: DataFrame, by: str, order: list, size: int) -> DataFrame:
    """rows with step and slot: `size` rows a step, in order, within each `by`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumns({"step": F.floor(n / size).cast("long"), "slot": (n % size).cast("int")})


def first_wins(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key: the first in order."""
    return rows.withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r__ = 1").drop("r__")


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """(presentations, keys): how many keys occur how often."""
    return rows.groupBy(key).agg(F.count("*").alias("presentations")).groupBy("presentations").agg(F.count("*").alias("keys"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first n rows of each stratum by key; a control pick, not a sample of the data."""
    return rows.withColumn("r__", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("r__") <= n).drop("r__")
