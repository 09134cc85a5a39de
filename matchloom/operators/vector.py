"""Nearest entities by vector: per channel, over all rows of a gallery.

A gallery row has an entity, a channel and a vector. The score of an entity in a channel is its best row's. Queries and gallery are packed in blocks, and groups of
blocks meet in a grid, so that a block is sent once for each group of the other side. A task multiplies its blocks and sends the best row per query,
channel and entity only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.numbers import length

from .graph import checkpointed

#: Rows of a block, and blocks of a group of the grid.
QUERY_BLOCK, GALLERY_BLOCK, GROUP = 1024, 4096, 8


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))


def _packed(rows: DataFrame, most: int, vector: str) -> DataFrame:
    """(dim, block, payload): up to `most` rows with vectors of one length as an Arrow stream. The vector is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                own = batch if (sizes == dim).all() else batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for lo in range(0, own.num_rows, most):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema) as out:
                        out.write_batch(own.slice(lo, most))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["dim", "block", "payload"])
                    k += 1

    return usable(rows, vector).mapInArrow(run, "dim int, block long, payload binary")


def _unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    own = column.combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)


def _codes(*columns: pa.Array) -> np.ndarray:
    """A number for each row: equal where all columns are equal, nulls being one value."""
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(values, len(known)) for values in zip(*(c.to_pylist() for c in columns), strict=True)], np.int64)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """(len(a), len(b)): which values are equal; null equals nothing."""
    both = _codes(pa.chunked_array([a, b]).combine_chunks() if a.type == b.type else pa.chunked_array([a.cast(b.type), b]).combine_chunks())
    x, y = both[: len(a)], both[len(a) :]
    return (x[:, None] == y[None, :]) & ~np.asarray(a.is_null())[:, None]


def norm_report(rows: DataFrame, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: n, vectors that are not finite or not of length 1, smallest and largest dimension."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x)) | (F.abs(length(v) - 1) > tolerance)
    return rows.agg(F.count("*").alias("n"), F.count_if(bad | v.isNull()).alias("n_bad"), F.min(F.size(v)).alias("min_dim"), F.max(F.size(v)).alias("max_dim"))


def entity_scores(queries: DataFrame, gallery: DataFrame, query_id: str = "query_id", row_id: str = "row_id", entity: str = "entity", channel: str = "channel", vector: str = "vector") -> DataFrame:
    """(query_id, channel, entity, score, row_id): the best row of each entity in each channel; ties go to the smaller row id, nulls last.

    Queries: query_id, vector. A query is not compared with the gallery row of its own id, nor with vectors of another length. Rows of either side whose vector is null, empty or holds null or
    non-finite components take no part. A null entity or channel is a value of its own; ids are of any type that sorts; repeated rows of the gallery change nothing, and the rows of one query id count as one query.
    """
    kinds = gallery.schema
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("channel", kinds[channel].dataType), T.StructField("entity", kinds[entity].dataType), T.StructField("score", T.DoubleType()), T.StructField("row_id", kinds[row_id].dataType)])
    asked, rows = checkpointed(_packed(queries.select(query_id, vector), QUERY_BLOCK, vector)), checkpointed(_packed(gallery.select(row_id, channel, entity, vector), GALLERY_BLOCK, vector))
    p, q = (max(1, -(-side.count() // GROUP)) for side in (asked, rows))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).alias
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias
    left = asked.select("dim", place(p)("g"), every(q)("h"), F.col("payload").alias("query_rows"))
    right = rows.select("dim", every(p)("g"), place(q)("h"), F.col("payload").alias("gallery_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield tile(_unpacked(x), _unpacked(y))

    def tile(some: pa.Table, held: pa.Table) -> pa.RecordBatch:
        ids, q = some.column(0).combine_chunks(), _matrix(some.column(1))
        own, chan, ent, x = *(held.column(k).combine_chunks() for k in range(3)), _matrix(held.column(3))
        scores = np.zeros((len(q), len(x)))
        for d in range(x.shape[1]):  # a sum from the first component on, so that equal vectors have equal scores
            scores += q[:, d : d + 1] * x[None, :, d]
        scores[_same(ids, own)] = -np.inf
        key = _codes(chan, ent)
        # rows in order of key, then id: the first of the largest scores of a key is the one of the smallest id
        places = np.empty(len(x), np.int64)
        places[pc.sort_indices(own, null_placement="at_end").to_numpy()] = np.arange(len(x))
        order = np.lexsort((places, key))
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        which, best = [], []
        for at in np.split(order, starts[1:]):
            first = at[np.argmax(scores[:, at], axis=1)]
            ok = np.flatnonzero(np.isfinite(scores[np.arange(len(q)), first]))
            which.append(ok)
            best.append(first[ok])
        i, j = np.concatenate(which), np.concatenate(best)
        columns = [ids.take(pa.array(i)), chan.take(pa.array(j)), ent.take(pa.array(j)), pa.array(scores[i, j]), own.take(pa.array(j))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = left.join(right, ["dim", "g", "h"]).select("query_rows", "gallery_rows").mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("score")).alias("back"), F.col("row_id").isNull().alias("unknown"), "row_id")).alias("best")
    return out.groupBy("query_id", "channel", "entity").agg(best).select("query_id", "channel", "entity", (-F.col("best.back")).alias("score"), "best.row_id")


def ranked(scores: DataFrame, by: list[str], score: str = "score", key: str = "entity") -> DataFrame:
    """rank (score down, key up), margin to the next (null for the last), gap to the first."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scores.withColumns({"rank": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w), "gap": F.first(score).over(w) - F.col(score)})


def top(scores: DataFrame, by: list[str], k: int, score: str = "score", key: str = "entity") -> DataFrame:
    return ranked(scores, by, score, key).where(F.col("rank") <= k)


def union_ranking(ranks: DataFrame, channels: tuple, k: int) -> DataFrame:
    """(query_id, entity, score_<c>..., union_rank, disagree): the union of the k best of each channel.

    Order: score of the first channel down, missing last, then entity. disagree: the channels have different first entities.
    """
    kept = ranks.where(F.col("rank") <= k)
    cells = [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"score_{c}") for c in channels]
    firsts = [F.max(F.when((F.col("channel") == c) & (F.col("rank") == 1), F.col("entity"))).alias(f"first_{c}") for c in channels]
    pool = kept.groupBy("query_id", "entity").agg(*cells, *firsts)
    whole = Window.partitionBy("query_id")
    order = whole.orderBy(F.col(f"score_{channels[0]}").desc_nulls_last(), "entity")
    first = [F.max(f"first_{c}").over(whole) for c in channels]
    apart = F.lit(False)
    for f in first[1:]:
        apart = apart | ~f.eqNullSafe(first[0])
    return pool.select("query_id", "entity", *(f"score_{c}" for c in channels), F.row_number().over(order).alias("union_rank"), apart.alias("disagree"))


def hits(ranks: DataFrame, truth: DataFrame, by: list[str], at: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Per group: n queries, queries whose true entity is at rank k or better, mean reciprocal rank. truth: query_id, truth."""
    own = truth.join(ranks, (truth["query_id"] == ranks["query_id"]) & (truth["truth"] == ranks["entity"]), "left").drop(ranks["query_id"])
    return own.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in at), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def unmatched(rows: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """rows less those whose key is excluded; the anti-join lets the filter reach the scan."""
    return rows.join(excluded.select(on), on, "left_anti")

