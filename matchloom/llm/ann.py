"""Nearest neighbours by a block matrix join.

Vectors are coded once: x is scale * int8 codes plus a residual of known length. They travel in blocks, and a tile of the join is a group of query
blocks and a group of row blocks, both of about TILE_BYTES, so that a vector is sent once for each group of the other side. A product of codes gives every
inner product of a tile up to an error that is bounded by the lengths: pairs whose upper bound is below what k rows of their query are known to
reach go. The others are computed again in double precision and kept in a heap of k a query; the heaps of all tiles are merged. No neighbour can be lost, so
recall is 1. Vectors whose components are too small or too large for codes have codes of zero and a residual of their whole length: their pairs are all computed again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Bytes of exact vectors that a tile holds of either side.
TILE_BYTES = 32 << 20
#: Components beyond these are not coded.
SMALLEST, LARGEST = 1e-140, 1e140


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) with finite components, none null, not all zero, and an id; of rows with one id the smallest vector stays."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.where(finite & F.exists(v, lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


class Coded:
    """Vectors with their int8 codes, scales, lengths and lengths of what the codes leave out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None = None, figures: np.ndarray | None = None):
        self.ids, self.x = ids, x
        if codes is None:
            wide = x.astype(np.float64)
            most = np.abs(wide).max(axis=1)
            fit = (most >= SMALLEST) & (most <= LARGEST)
            scale = np.where(fit, most / 127, 0.0)
            with np.errstate(over="ignore"):
                # components as shares of the largest one: their squares neither vanish nor overflow
                share = wide / most[:, None]
                length = most * np.sqrt((share * share).sum(axis=1))
                codes = np.where(fit[:, None], np.rint(share * 127), 0).astype(np.int8)
                left = share - codes / 127
                rest = np.where(fit, most * np.sqrt((left * left).sum(axis=1)) + 1e-12 * length, length)
            figures = np.stack([scale, length, rest])
        self.codes = codes
        self.scale, self.length, self.rest = figures
        self.figures = figures

    def packed(self) -> list[bytes]:
        return [self.ids.astype("<i8").tobytes(), self.x.tobytes(), self.codes.tobytes(), self.figures.tobytes()]

    @classmethod
    def of(cls, dim: int, ids: bytes, data: bytes, codes: bytes, figures: bytes) -> Coded:
        own = np.frombuffer(ids, "<i8")
        x = np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(own) else "<f8").reshape(-1, dim)
        return cls(own, x, np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(figures, np.float64).reshape(3, -1))


_PACKED = ["ids", "data", "codes", "figures"]


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(dim, block, ids, data, codes, figures): coded vectors of one length; data as little-endian doubles, or floats where the column has floats."""
    wide = isinstance(rows.schema["v"].dataType.elementType, T.DoubleType)
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in _PACKED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = batch.column(1)
            offsets = v.offsets.to_numpy().astype(np.int64)
            flat = v.values.to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4")
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), most):
                    own = at[lo : lo + most]
                    coded = Coded(ids[own], flat[(offsets[own][:, None] + np.arange(dim))])
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([k], pa.int64()), *(pa.array([x]) for x in coded.packed())], names=schema.names)
                    k += 1

    return rows.select("id", "v").mapInArrow(run, schema)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component on."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return out


def tile(q: Coded, r: Coded, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs that may be among the k best of their query; floor: a score that k rows are known to reach, or -inf."""
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    about = (q.codes.astype(kind) @ r.codes.astype(kind).T).astype(np.float64)
    about *= q.scale[:, None]
    about *= r.scale[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        slack = q.rest[:, None] * r.length[None, :] + (q.length + q.rest)[:, None] * r.rest[None, :] + 1e-9 * q.length[:, None] * r.length[None, :] + np.finfo(np.float64).tiny
        slack[np.isnan(slack)] = np.inf
        own = q.ids[:, None] == r.ids[None, :]
        low = np.where(own, -np.inf, about - slack)
        if low.shape[1] > k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        i, j = np.nonzero((about + slack >= floor[:, None]) & ~own)
        scores = exact(q.x[i], r.x[j])
    known = ~np.isnan(scores)
    return i[known], j[known], scores[known]


class Heaps:
    """The k best (score, smaller id first) of each query, as heaps whose first is the worst kept."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for q, entry in zip(i.tolist(), zip(scores.tolist(), (-ids).tolist(), strict=True), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for q in np.unique(i).tolist():
            if len(self.heaps[q]) == self.k:
                self.floor[q] = self.heaps[q][0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score)"""
        sizes = [len(h) for h in self.heaps]
        kept = [e for h in self.heaps for e in h]
        return np.repeat(np.arange(len(sizes)), sizes), np.array([-e[1] for e in kept], np.int64), np.array([e[0] for e in kept], np.float64)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row for which `queries` holds, all rows but its own being candidates.

    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length are no
    candidates of a query; rows of equal id count once (the smallest vector); a pair whose product is no number in
    double precision (infinities of both signs) is no candidate; a query without candidates gives no rows; other columns play no part.
    """
    base = checkpointed(_blocks(usable(vectors, id_column, vector_column), row_block))
    asked = checkpointed(_blocks(usable(vectors.where(queries), id_column, vector_column), query_block))
    # one row for each length of vector: into how many groups of about TILE_BYTES either side is dealt
    sizes = lambda blocks, name: blocks.groupBy("dim").agg(F.ceil(F.sum(F.octet_length("data")) / tile_bytes).cast("int").alias(name))
    grid = F.broadcast(sizes(base, "n_rows").join(sizes(asked, "n_queries"), "dim"))
    place = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "dim").select("dim", place("n_queries").alias("g"), every("n_rows").alias("h"), *_PACKED)
    right = base.join(grid, "dim").select("dim", every("n_queries").alias("g"), place("n_rows").alias("h"), *_PACKED)

    def task(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        column = lambda t: list(zip(t.column("dim").to_pylist(), *(t.column(n) for n in _PACKED), strict=True))
        coded = lambda row: Coded.of(row[0], *(memoryview(x.as_buffer()) for x in row[1:]))
        for a in column(asked):
            q = coded(a)
            heaps = Heaps(len(q.ids), k)
            for b in column(rows):
                r = coded(b)
                i, j, scores = tile(q, r, k, heaps.floor)
                heaps.add(i, r.ids[j], scores)
            i, ids, scores = heaps.rows()
            out.append((q.ids[i], ids, scores))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = left.groupBy("dim", "g", "h").cogroup(right.groupBy("dim", "g", "h")).applyInArrow(task, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, modulus: int = 20) -> str:
    return f"""
WITH usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END), 'sum') = 0
  AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score FROM usable q JOIN usable r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % {modulus} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
