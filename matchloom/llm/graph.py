"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join on the smaller end of every edge, so that no neighbourhood is gathered in one
task: the smallest neighbour is an aggregate (combined before the shuffle), and a hub only makes its rows of the join
many, which adaptive execution splits. The graph shrinks to one star per component in a number of steps that grows with
the logarithm of its size. Lineage is cut by a reliable checkpoint after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, few


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

    edges: columns u and v of one orderable type, undirected; loops, repeats and nulls are ignored. An edge table without
    rows gives no rows. It raises if `most_rounds` rounds do not suffice.
    """
    now = edges.where("u is not null and v is not null and u != v")
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(most_rounds):
        now = checkpointed(few(_small_star(_large_star(now)), n))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of the component of each of n nodes."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (deeper := root[root]).tobytes() != root.tobytes():
                root = deeper
    return root
