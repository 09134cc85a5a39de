"""Connected components and reliable checkpoints.

Components come from alternating large-star and small-star steps. Each step is one aggregation and one join on the smaller end of every
edge, so that no neighbourhood is gathered in one task: the smallest neighbour is an aggregate (combined before the shuffle),
and a hub only makes its rows of the join many, which adaptive execution splits. The graph shrinks to one star per component in a
number of steps that grows with the logarithm of its size.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, written to the shared folder of spark.checkpoint.dir.

    Where the session names no such folder, a temporary one is set if all runs on one machine; else it raises.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Rows (of about 100 bytes) up to which a side of a join is broadcast.
MOST_BROADCAST = 200_000


def sided(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, which is written, marked to be broadcast if it has at most `most` rows; else it is joined by a shuffle, even where Spark takes it for small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


#: Rows (of about 100 bytes) that a task of spread rows is dealt.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to as many tasks as its rows need, so that a task's memory does not grow with the input. rows: their number, if it is known; else they are counted, which for columns of a file reads no rows."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), *keys)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the smallest of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): every node that has an edge, and the smallest node of its component.

    edges: columns u and v of one orderable type, undirected; loops, repeats and nulls are ignored. An edge table without rows gives
    no rows. It raises if `most_rounds` rounds do not suffice.
    """
    now = edges.where("u is not null and v is not null and u != v")
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(most_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def running(rows: DataFrame, order: list[str], value: str, by: str | None = None) -> DataFrame:
    """rows (written) with `before`, the sum of `value` over the rows that come before in the order, within `by` if given. Rows of one place in the order must be one.

    Rows are dealt by ranges of the order; sums of whole ranges, of which there are few, are added to those inside a range, so that no group is one task.
    """
    keys = ([by] if by else []) + order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(parts, *keys).withColumn("range__", F.spark_partition_id()))
    group = ([by] if by else []) + ["range__"]
    sums = dealt.groupBy(*group).agg(F.sum(value).alias("sum__"))
    whole = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))  # one row a range
    starts = sums.withColumn("start__", F.coalesce(F.sum("sum__").over(whole.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum__")
    starts = starts.select(*(F.col(c).alias(f"{c}_s") for c in group), "start__")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(starts), same).withColumn("before", F.col("start__") + inside).drop("range__", "start__", *(f"{c}_s" for c in group))
