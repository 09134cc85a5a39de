"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbouring words, and its pairs with one word left out, each present or not,
hashed to 2**BITS places. FTRL-proximal gives every place its own rate and sets small ones to zero, so the weights that are
broadcast are few. Rounds: every shard of the training rows runs from the shared state, and the mean of what the shards changed
is added to it, both to the sums of gradients and to those of their squares: a place's rate is that of a run over one shard a round, not over all
of them. Slope and shift that turn sums of weights into probabilities come from rows that no shard has learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed
from .words import ALNUM, Texts, mix, slices

BITS = 20
#: The bound of the training sample, in documents; it is dealt by hash over shards, but for one row in CALIBRATE, which are of shard SHARDS.
TRAIN_DOCS, SHARDS, CALIBRATE = 16_000, 8, 10


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every feature, repeats included."""
    h, owner, room = t.hashes(), t.owner(), t.room()
    two, three = np.flatnonzero(room >= 2), np.flatnonzero(room >= 3)
    pairs = mix(h[two] * np.uint64(3) + h[two + 1], 2) if len(two) else h[:0]
    skips = mix(h[three] * np.uint64(3) + h[three + 2], 3) if len(three) else h[:0]
    place = np.concatenate([mix(h, 1), pairs, skips]) >> np.uint64(64 - BITS)
    return place.astype(np.uint32), np.concatenate([owner, owner[two], owner[three]])


class Ftrl:
    """The state of FTRL-proximal: z and n by place, and of the intercept, which is not made sparse."""

    def __init__(self, alpha: float = 4.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = np.zeros(2)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def intercept(self) -> float:
        z, n = self.bias
        return float(-z / ((self.beta + np.sqrt(n)) / self.alpha))

    def learn(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.intercept()
        p = 1.0 / (1.0 + np.exp(-np.clip(b + w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        root = np.sqrt(self.bias[1])
        self.bias += (g - (np.sqrt(self.bias[1] + g * g) - root) / self.alpha * b, g * g)


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as compressed gaps, byte by byte."""
    gaps = np.diff(places, prepend=places.dtype.type(0)).astype("<u4")
    raw = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(gaps).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    raw = np.frombuffer(pa.decompress(packed[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").reshape(-1), dtype=np.uint32)


def _featurised(docs: DataFrame) -> DataFrame:
    """(row_key, label, shard, places) of labelled texts; places are the distinct ones, packed."""
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("shard", T.IntegerType()), T.StructField("places", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in slices(batch.column(3), ALNUM, lower=True):
                place, owner = features(t)
                both = np.unique(owner.astype(np.uint64) << np.uint64(BITS) | place)
                bounds = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(BITS))
                own = (both & np.uint64((1 << BITS) - 1)).astype(np.uint32)
                packed = [_packed(own[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(packed, pa.binary())], names=schema.names)

    return docs.select("row_key", "label", "shard", "text").mapInArrow(run, schema)


def _shard_pass(shared, passes: int):
    """A function from a partition of training rows to what running over each of its shards changes in the shared state."""

    def run(parts):
        import pandas as pd

        rows: dict[int, list] = {}
        for pdf in parts:
            for shard, key, y, p in zip(pdf["shard"], pdf["row_key"], pdf["label"], pdf["places"], strict=True):
                rows.setdefault(shard, []).append((key, y, p))
        for shard in sorted(set(rows) - {SHARDS}):
            own = Ftrl()
            z, n, bias = shared.value
            own.z[:], own.n[:], own.bias[:] = z, n, bias
            ready = [(_unpacked(p), y) for _, y, p in sorted(rows[shard])]
            for _ in range(passes):
                for at, y in ready:
                    own.learn(at, y)
            yield pd.DataFrame({"dz": [(own.z - z).astype(np.float32).tobytes()], "dn": [(own.n - n).astype(np.float32).tobytes()], "b0": [own.bias[0] - bias[0]], "b1": [own.bias[1] - bias[1]]})

    return run


_CHANGE = "dz binary, dn binary, b0 double, b1 double"


def _mean_change(pdf):
    """The mean of the changes of all shards: SHARDS rows of two arrays of 2**BITS places."""
    import pandas as pd

    dz, dn = (np.mean([np.frombuffer(x, np.float32) for x in pdf[c]], axis=0, dtype=np.float32) for c in ("dz", "dn"))
    return pd.DataFrame({"dz": [dz.tobytes()], "dn": [dn.tobytes()], "b0": [pdf["b0"].mean()], "b1": [pdf["b1"].mean()]})


def _logits(shared):
    """A function from a partition of rows to (label, logit)."""

    def run(parts):
        import pandas as pd

        at, weights, intercept = shared.value
        w = np.zeros(1 << BITS)
        w[at] = weights
        for pdf in parts:
            yield pd.DataFrame({"label": pdf["label"], "logit": [float(w[_unpacked(p)].sum() + intercept) for p in pdf["places"]]})

    return run


def calibration(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities: Newton steps on smoothed labels (of n rows, 1 and 0 are (n + 1) / (n + 2) and 1 / (n + 2))."""
    up = label > 0.5
    if not up.any() or up.all():
        return 1.0, 0.0
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    x, theta = np.column_stack([logit, np.ones(len(logit))]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target) + 1e-4 * (theta - [1.0, 0.0]))
        theta = theta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(row_key, label, shard, places) of at most about `most` labelled documents (doc_id, toxic), chosen by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("label"))
    there = known.count()
    share = min(1.0, most / max(1, there))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.col("doc_id").alias("id"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    key = F.xxhash64(F.col("doc_id"), F.lit(7))
    shard = F.when(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(CALIBRATE)) == 0, SHARDS).otherwise(F.pmod(key, F.lit(SHARDS)))
    ready = _featurised(rows.select(key.alias("row_key"), "label", shard.cast("int").alias("shard"), "text"))
    return checkpointed(ready.repartition(SHARDS + 1, "shard"))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 4, passes: int = 2, most: int = TRAIN_DOCS) -> dict:
    """Weights from at most about `most` labelled documents (doc_id, toxic), chosen by a hash of the id.

    Null ids and labels are left out; of several labels of one id the largest counts. The result has the places whose weight is not
    zero, their weights, and the intercept, all calibrated. Without any labels all weights are zero and every score is 0.5.
    """
    sc = docs.sparkSession.sparkContext
    ready = training_rows(docs, labels, most)
    state = Ftrl()
    for _ in range(rounds):
        shared = sc.broadcast((state.z.astype(np.float32), state.n.astype(np.float32), state.bias))
        change = ready.mapInPandas(_shard_pass(shared, passes), _CHANGE).groupBy().applyInPandas(_mean_change, _CHANGE).first()
        if change is not None:
            state.z += np.frombuffer(change["dz"], np.float32)
            state.n += np.frombuffer(change["dn"], np.float32)
            state.bias += np.array([change["b0"], change["b1"]])
        shared.destroy()
    w = state.weights(np.arange(1 << BITS))
    at = np.flatnonzero(w).astype(np.uint32)
    shared = sc.broadcast((at, w[at], state.intercept()))
    own = ready.where(F.col("shard") == SHARDS).mapInPandas(_logits(shared), "label double, logit double").collect()  # of the bounded sample
    shared.destroy()
    slope, shift = calibration(np.array([r["logit"] for r in own]), np.array([r["label"] for r in own]))
    return {"at": at, "weights": (slope * w[at]).astype(np.float32), "intercept": slope * state.intercept() + shift}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id and score in 0..1 of the whole text. Null and empty texts have the score of the intercept."""
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[shared.value["at"]] = shared.value["weights"]
        for batch in batches:
            for lo, hi, t in slices(batch.column(1), ALNUM, lower=True):
                place, owner = features(t)
                hit = np.flatnonzero(weights[place])
                both = np.unique(owner[hit].astype(np.uint64) << np.uint64(BITS) | place[hit])
                sums = np.bincount((both >> np.uint64(BITS)).astype(np.int64), weights[(both & np.uint64((1 << BITS) - 1)).astype(np.int64)].astype(np.float64), hi - lo)
                p = 1.0 / (1.0 + np.exp(-np.clip(sums + shared.value["intercept"], -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from labels that are not held out. Texts alone are inputs of a score.

    Null and empty texts, repeated rows, ties and an empty table each give one row per row of docs; other columns play no part.
    """
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
