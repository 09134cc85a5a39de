"""Product codes: every vector as one small codebook index for each of its parts.

A codebook starts as the parts of the rows of the smallest ids. In each round a kd-tree of every codebook is broadcast, every part goes to its nearest entry, and the
entries move to the floor of the mean of their parts, by integer sums that each task adds up for its rows and Spark for all tasks. All figures are integers, so that the
result does not depend on how rows are dealt.

The search descends to one leaf of the tree first and then walks the whole tree with what it found as bound: a node is left out if its box is farther than the bound. One that is equally far is
visited, since it may hold an entry of the same distance and a lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond it are held at it. Far below it int64 is exact (see _exact); where it is not, Python's integers are used.
LARGEST = 1 << 62
#: Components of vectors that a task works on at a time.
SLICE = 1 << 20
#: Labels up to which their sums are broadcast.
MOST_LABELS = 100_000
LEAF = 4


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, parts: int) -> DataFrame:
    """(id, label, v): vectors with components, all finite, that can be cut into `parts` equal parts."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & finite)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def _exact(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether squared distances of whole rows fit in int64."""
    most = max((int(np.abs(a).max()) for a in (points, entries) if a.size), default=0)
    return 4 * most * most * max(1, points.shape[1]) < 1 << 62


class Tree:
    """A kd-tree over the entries of a codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        #: of each node: entries (ascending) of a leaf or None, children, axis and threshold of the split, box of its entries
        self.nodes: list[tuple] = []
        self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> int:
        at, box = len(self.nodes), self.entries[own]
        low, high = box.min(axis=0), box.max(axis=0)
        self.nodes.append(())
        axis = int(np.argmax(high - low))
        if len(own) <= LEAF or low[axis] == high[axis]:
            self.nodes[at] = (np.sort(own), -1, -1, 0, 0, low, high)
            return at
        column = box[:, axis]
        middle = np.sort(column)[(len(own) - 1) // 2]
        if middle == high[axis]:  # else the right side would be empty
            middle = column[column < middle].max()
        left = column <= middle
        self.nodes[at] = (None, self._build(own[left]), self._build(own[~left]), axis, middle, low, high)
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones the lowest index."""
        if not _exact(points, self.entries):
            points = points.astype(object)
        kind = points.dtype
        n = len(points)
        home, who, best = np.zeros(n, np.int64), np.full(n, len(self.entries)), np.zeros(n, kind)
        inner, left, right, axis = (np.array([f(x) for x in self.nodes]) for f in (lambda x: x[0] is None, lambda x: x[1], lambda x: x[2], lambda x: x[3]))
        middle = np.array([x[4] for x in self.nodes], dtype=kind)
        while (rows := np.flatnonzero(inner[home])).size:
            node = home[rows]
            home[rows] = np.where(points[rows, axis[node]] <= middle[node], left[node], right[node])
        for k in np.unique(home).tolist():
            self._leaf(k, np.flatnonzero(home == k), points, who, best, first=True)
        todo = [(0, np.arange(n))]
        while todo:
            k, rows = todo.pop()
            own, left, right, _, _, low, high = self.nodes[k]
            away = np.maximum(np.maximum(low.astype(kind) - points[rows], points[rows] - high.astype(kind)), 0)
            rows = rows[(away * away).sum(axis=1) <= best[rows]]
            if own is not None:
                rows = rows[home[rows] != k]
            if rows.size:
                if own is None:
                    todo += [(left, rows), (right, rows)]
                else:
                    self._leaf(k, rows, points, who, best)
        return who, best

    def _leaf(self, k: int, rows: np.ndarray, points: np.ndarray, who: np.ndarray, best: np.ndarray, first: bool = False) -> None:
        for e in self.nodes[k][0].tolist():
            apart = points[rows] - self.entries[e].astype(points.dtype)
            far = (apart * apart).sum(axis=1)
            better = (far < best[rows]) | (far == best[rows]) & (e < who[rows]) if not first else np.ones(len(rows), bool)
            best[rows[better]], who[rows[better]], first = far[better], e, False


class Codebooks:
    """entries: integers by part, entry and position within the part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for: its entries' integers, as components again."""
        return [int(c) / SCALE for p, e in enumerate(bytes.fromhex(code)) for c in self.entries[p, e]]


def _cut(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their integers, some at a time."""
    for batch in batches:
        step = max(1, SLICE // dim)
        for lo in range(0, batch.num_rows, step):
            own = batch.slice(lo, step)
            yield own, whole(own.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round: every entry that parts chose is the floor of their mean."""
    parts, entries, d = books.entries.shape
    trees = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = np.zeros((parts, entries), np.int64), np.zeros((parts * d, entries), object)
        for _, x in _cut(batches, parts * d):
            small = np.abs(x).max(initial=0) < 1 << 30  # then sums of a slice are exact in double precision
            for p, tree in enumerate(trees.value):
                own, _ = tree.nearest(x[:, p * d : (p + 1) * d])
                n[p] += np.bincount(own, minlength=entries)
                for c in range(p * d, (p + 1) * d):
                    if small:
                        totals[c] += np.bincount(own, weights=x[:, c], minlength=entries).astype(np.int64)
                    else:
                        np.add.at(totals[c], own, x[:, c].astype(object))
        c, e = np.nonzero(np.repeat(n, d, axis=0))
        sums = pa.array([Decimal(int(v)) for v in totals[c, e]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(e, pa.int32()), pa.array(n[c // d, e]), sums], names=["component", "entry", "n", "total"])

    # a task gives a row for each component and entry at most, and so does the sum
    sums = rows.select("v").mapInArrow(run, "component int, entry int, n long, total decimal(38,0)").groupBy("component", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = books.entries.copy()
    for r in sums.collect():
        new[r.component // d, r.entry, r.component % d] = int(r.total) // r.n
    trees.unpersist()
    return Codebooks(new)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of (id, v) rows, see usable(); None if there are none.

    Null ids come last; of rows with one id the smaller vector comes first. The length of the first row's vector is the length that is coded.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits: 256 entries at most")
    smallest = lambda some: some.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = smallest(rows)
    if not first:
        return None
    if len({len(r.v) for r in first}) > 1:
        first = smallest(rows.where(F.size("v") == len(first[0].v)))
    start = whole(np.array([r.v for r in first], np.float64))
    books = Codebooks(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(rows.where(F.size("v") == books.dim), books)
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of the rows of the codebooks' length, written. error is null where it does not fit in a long."""
    kinds = rows.schema
    schema = T.StructType([kinds["id"], kinds["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    trees, (_, _, d) = rows.sparkSession.sparkContext.broadcast(books.trees()), books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, x in _cut(batches, books_dim):
            codes, error = np.zeros((len(x), len(trees.value)), np.uint8), np.zeros(len(x), object)
            for p, tree in enumerate(trees.value):
                codes[:, p], far = tree.nearest(x[:, p * d : (p + 1) * d])
                error += far
            digits = codes.tobytes().hex()
            width = 2 * codes.shape[1]
            code = [digits[i : i + width] for i in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), pa.array(code), pa.array([int(v) if v < 1 << 63 else None for v in error], pa.int64())], names=schema.names)

    books_dim = books.dim
    out = checkpointed(rows.where(F.size("v") == books.dim).mapInArrow(run, schema))
    trees.unpersist()
    return out


def report(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(<id>, code, error, label_error, codebooks_sha256) of every vector that takes part.

    Vectors that are null, empty, hold null or non-finite components, or cannot be cut into equal parts take no part, nor do those of another length than that of the smallest id; with fewer
    rows than `entries` codebooks have fewer entries; every copy of a repeated row is coded and counts in the sums; null ids are coded, and come last at the start. Components whose integers are
    beyond 2**62 are held at it. Errors that do not fit in a long are null, as is the label_error of their label. A table without usable vectors gives no rows; other columns play no part.
    """
    rows = usable(vectors, id_column, vector_column, label_column, parts)
    books = fit(rows, parts, entries, rounds)
    if books is None:
        none = F.lit(None).cast("string")
        return rows.where("false").select(F.col("id").alias(id_column), none.alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.alias("codebooks_sha256"))
    coded = encoded(rows, books)
    total = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")
    sums = checkpointed(coded.groupBy(F.col("label").alias("own")).agg(F.when(F.count("*") == F.count("error"), total).alias("label_error")))
    side = F.broadcast(sums) if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS else sums
    joined = coded.join(side, F.col("label").eqNullSafe(F.col("own")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """All distances of every part and entry, round by round."""
    nearest = "SELECT vec_id, p.part, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT * 1000 + entry) AS best FROM p JOIN b{k} b USING (part) GROUP BY ALL"
    steps = []
    for k in range(rounds):
        steps.append(f"""
a{k} AS MATERIALIZED ({nearest.format(k=k)}),
s{k} AS MATERIALIZED (SELECT part, best % 1000 AS entry, i, sum(x[i])::BIGINT AS total, count(*) AS n
  FROM a{k} JOIN p USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, list(coalesce((total - ((total % n) + n) % n) // n, y[i.i]) ORDER BY i.i) AS y
  FROM b{k} b CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) i LEFT JOIN s{k} s ON s.part = b.part AND s.entry = b.entry AND s.i = i.i GROUP BY b.part, b.entry)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS y FROM p QUALIFY entry < {entries}),{",".join(steps)},
last AS MATERIALIZED ({nearest.format(k=rounds)}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 1000), '' ORDER BY part) AS code, sum(best // 1000)::BIGINT AS error FROM last GROUP BY vec_id),
whole AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), whole"""
