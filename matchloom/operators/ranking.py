"""Ranking pools, guarded changes, and a sign-bounded listwise fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.numbers import linear

from .graph import spread


def linear_rank(rows: DataFrame, by: str, key: str, weights: dict[str, float], scales: dict[str, float] | None = None, support: str | None = None) -> DataFrame:
    """rows with score, rank (score down, support down, key up) and the margin of the first over the second."""
    scored = rows.withColumn("score", F.round(linear(weights, scales), 9))
    order = [F.desc("score"), *([F.desc(support)] if support else []), F.asc(key)]
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumns({"rank": F.row_number().over(w), "margin": F.when(F.row_number().over(w) == 1, F.col("score") - F.lead("score").over(w))})


def promoted(rows: DataFrame, by: str, chosen: Column, rank: str = "rank") -> DataFrame:
    """rows with new_rank: the chosen row first, the others in their order."""
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.when(chosen, 0).otherwise(1), rank)))


def agreed(rows: DataFrame, by: str, channel: str, key: str, rank: str = "rank", least: int = 2) -> DataFrame:
    """(by, key): the one candidate that is first in every channel that has a first, if there are at least `least` such channels."""
    firsts = rows.where(F.col(rank) == 1).groupBy(by).agg(F.countDistinct(channel).alias("channels"), F.countDistinct(key).alias("keys"), F.min(key).alias(key))
    return firsts.where((F.col("keys") == 1) & (F.col("channels") >= least)).select(by, key)


def agreed_first(rows: DataFrame, by: str, key: str, channels: dict[str, Column], least: int = 2) -> DataFrame:
    """agreed for channels that are scores of the same rows: the largest score is first, the smaller key among equals, and rows of a null score are not in the list.

    Rows are dealt by their group once and aggregated there, all channels at once.
    """
    firsts = [F.min(F.when(score.isNotNull(), F.struct((-score).alias("s"), F.col(key).alias("k")))).alias(f"{name}__") for name, score in channels.items()]
    cells = [F.col(f"{name}__") for name in channels]
    best = spread(rows, by).groupBy(by).agg(*firsts)
    keys = F.array_distinct(F.array_compact(F.array(*(c["k"] for c in cells))))
    n = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    return best.where((n >= least) & (F.size(keys) == 1)).select(by, keys[0].alias(key))


def resolved(rows: DataFrame, control: str, proposal: str, checks: dict[str, Column]) -> DataFrame:
    """rows with reasons (names of the checks that fail or are null, in order) and final: the proposal only where none fails, else the control."""
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n)) for n, c in checks.items()]), lambda r: r.isNotNull())
    out = rows.withColumn("reasons", F.array_join(reasons, ","))
    return out.withColumn("final", F.when((F.col("reasons") == "") & F.col(proposal).isNotNull(), F.col(proposal)).otherwise(F.col(control)))


def representative(rows: DataFrame, by: str, member: str, priority: list[Column]) -> DataFrame:
    """(by, member): the member that comes first by the priorities, then by itself."""
    w = Window.partitionBy(by).orderBy(*priority, member)
    return rows.withColumn("r__", F.row_number().over(w)).where("r__ = 1").select(by, member)


def perturbed(rows: DataFrame, weights: dict[str, float], step: float, scales: dict[str, float] | None = None) -> DataFrame:
    """(feature, n, raised, violations): how often a candidate's score grows, and how often it falls, if `step` times the sign of its weight is added to one feature.

    The feature's column is changed and the candidate is scored again, by the scorer that ranks; a weight of the wrong sign, a scale below zero or a clipped feature shows.
    """
    cells = []
    for name, w in weights.items():
        moved = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) + step * ((w > 0) - (w < 0))
        cells.append(F.struct(F.lit(name).alias("feature"), F.round(linear(weights, scales), 9).alias("base"), F.round(linear(weights, scales, {name: moved}), 9).alias("after")))
    each = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return each.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("after") > F.col("base")).alias("raised"), F.count_if(F.col("after") < F.col("base")).alias("violations"))


def without_feature(rows: DataFrame, by: str, key: str, weights: dict[str, float], feature: str) -> DataFrame:
    """(by, first, first_without): the best candidate with all weights, and with that of one feature set to zero."""
    less = {n: (0.0 if n == feature else w) for n, w in weights.items()}
    a = linear_rank(rows, by, key, weights).where("rank = 1").select(by, F.col(key).alias("first"))
    b = linear_rank(rows, by, key, less).where("rank = 1").select(by, F.col(key).alias("first_without"))
    return a.join(b, by)


def listwise_loss_gradient(rows: DataFrame, by: str, label: str, features: list[str], weights: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Mean over queries of logsumexp(all) - logsumexp(positives), and its gradient: one distributed aggregation, one small row back."""
    scored = rows.withColumn("s", linear(dict(zip(features, weights.tolist(), strict=True))))
    w = Window.partitionBy(by)
    top = scored.withColumn("m", F.max("s").over(w)).withColumn("e", F.exp(F.col("s") - F.col("m")))
    per = top.groupBy(by).agg(
        F.log(F.sum("e")).alias("all"), F.log(F.sum(F.when(F.col(label) == 1, F.col("e")))).alias("pos"),
        *[(F.sum(F.col("e") * F.col(f)) / F.sum("e") - F.sum(F.when(F.col(label) == 1, F.col("e") * F.col(f))) / F.sum(F.when(F.col(label) == 1, F.col("e")))).alias(f"g_{i}") for i, f in enumerate(features)],
    ).where("pos is not null")
    got = per.agg(F.avg(F.col("all") - F.col("pos")).alias("loss"), F.count("*").alias("n"), *[F.avg(f"g_{i}").alias(f"g_{i}") for i in range(len(features))]).first()
    return float(got["loss"] or 0.0), np.array([float(got[f"g_{i}"] or 0.0) for i in range(len(features))]), int(got["n"])


def fit_listwise(rows: DataFrame, by: str, label: str, features: list[str], signs: dict[str, int], ridge: float = 0.1, steps: int = 12) -> dict:
    """Weights bounded by sign (1: not below 0, -1: not above, 0: free) by projected gradient steps with backtracking.

    The data stay distributed; each trial is one aggregation. Queries without a positive are left out.
    """
    sign = np.array([signs.get(f, 0) for f in features])
    project = lambda w: np.where(sign > 0, np.maximum(w, 0), np.where(sign < 0, np.minimum(w, 0), w))
    w, rate = np.zeros(len(features)), 1.0
    loss, g, n = listwise_loss_gradient(rows, by, label, features, w)
    losses = [loss]
    for _ in range(steps):
        g_all = g + ridge * w
        for _ in range(8):
            new = project(w - rate * g_all)
            trial, g_new, _ = listwise_loss_gradient(rows, by, label, features, new)
            if trial + ridge / 2 * new @ new <= loss + ridge / 2 * w @ w - 1e-4 * (w - new) @ g_all:
                break
            rate /= 2
        else:
            break
        if np.abs(new - w).max() < 1e-6:
            break
        w, loss, g = new, trial, g_new
        losses.append(loss)
        rate *= 1.5
    return {"weights": dict(zip(features, w.tolist(), strict=True)), "losses": losses, "queries": n}


def placed(rows: DataFrame, by: str, order: list, name: str) -> DataFrame:
    """rows with their place, from 1, in each `by`."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
