"""Near copies by the Jaccard similarity of word-shingle sets: MinHash bands propose pairs, and the whole sets decide.

Rows of equal sets are one node. A band is a hash of a few minima of the set; two sets of similarity s share one of the bands with
probability 1 - (1 - s**ROWS)**BANDS, which is 0.9997 at s = 0.8 and grows with s. In each group of an equal band the members are first compared with its
smallest node, one band first and the others where that was no copy; then every pair whose nodes that leaves in different components is compared. So a large cluster of true copies costs
one comparison a member and band, and no pair of a group is left out. Groups that would make many such pairs, as texts around one long passage do, are compared in a grid of blocks:
a set travels once a block that it meets, not once a pair. Comparisons are of whole sets, as 32-bit shingle hashes: two texts of a thousand
words share a stranger by chance once in some thousand pairs. The sets are made once and only for rows that are in some pair; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, forest
from .session import ROWS_A_FILE, checkpointed, dealt, few, may_hold, small_batches
from .words import SPACE, Texts, mix, runs, slices

SHINGLE, BANDS, ROWS = 5, 20, 5
#: Similarity from which two sets are near copies, as a fraction.
LEAST = (4, 5)
#: Bytes of sets in a block of the grid, how much less a group's blocks must carry than its pairs do, which are one over all bands, and shingles a step.
BLOCK_BYTES, FEWER, STEP = 512 << 10, 4, 2048

_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 0x1F83D9AB) | np.uint64(1)


def shingle_sets(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text d, sorted, are hashes[first[d]:first[d + 1]]. A text of fewer words is one shingle."""
    h, n = t.hashes(), len(t.offsets) - 1
    values, owners = [], []
    own = runs(h, k)
    at = np.flatnonzero(t.room()[: len(own)] >= k)
    values.append(own[at])
    owners.append(t.owner()[at])
    for few in range(1, k):
        short = np.flatnonzero(t.n_words == few)
        if len(short):
            values.append(runs(h, few)[t.first[short]])
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def bands(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bands of each text (a row of BANDS hashes); zeros for one without shingles."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    if len(some):
        for b in range(BANDS):
            folded = np.full(len(some), b, np.uint64)
            for m in _MULTIPLIERS[b * ROWS : (b + 1) * ROWS]:
                folded = mix(folded ^ np.minimum.reduceat(value * m, first[:-1][some]), b + 1)
            out[some, b] = folded
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """(row, doc_id, same, bands) of rows (row, doc_id, text): `same` is a digest of the whole set, bands is empty for texts without words."""
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            for lo, hi, t in slices(batch.column(2), SPACE, lower=True):
                value, first = shingle_sets(t)
                b = bands(value, first).view(np.int64)
                some = np.diff(first) > 0
                digests = [xxh128_digest(value[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(b[some].reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(digests, pa.binary()), lists], names=schema.names)

    return rows.select("row", "doc_id", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles): the upper halves of the sorted hashes as bytes, of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in slices(batch.column(1), SPACE, lower=True):
                value, first = shingle_sets(t)
                short = (value >> np.uint64(32)).astype(np.uint32)
                packed = [short[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["node", "shingles"])

    return rows.select("row", "text").mapInArrow(run, "node long, shingles binary")


def _near(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """Those of the pairs (u, v), which are distinct and `most` at most, whose sets are at least LEAST alike. sets: (node, shingles), dealt by node."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    p, q = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
                    ok.append(False)
                    continue
                shared = len(np.intersect1d(a, b))
                ok.append(shared * q >= (len(a) + len(b) - shared) * p)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    # compared in as many tasks as a shuffle has, and written in as few files as so many pairs need
    with small_batches(pairs.sparkSession, 1000):
        return checkpointed(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long").repartition(max(1, -(-most // ROWS_A_FILE))))


def _alike(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, places in y) of sets that are at least LEAST alike, by products of the matrices of members and shared shingles."""
    p, q = LEAST
    sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    values = [np.concatenate(side) for side in (x, y)]
    both = np.intersect1d(*values)
    held = []
    for v, n in zip(values, sizes, strict=True):
        at = np.searchsorted(both, v)
        some = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == v) if len(both) else np.zeros(0, np.int64)
        some = some[np.argsort(at[some], kind="stable")]
        held.append((at[some], np.repeat(np.arange(len(n)), n)[some]))
    shared = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(both), STEP):
        sides = []
        for (at, owner), n in zip(held, sizes, strict=True):
            i, j = np.searchsorted(at, (lo, lo + STEP))
            member = np.zeros((len(n), min(STEP, len(both) - lo)), np.float32)
            member[owner[i:j], at[i:j] - lo] = 1
            sides.append(member)
        shared += sides[0] @ sides[1].T
    common = shared.astype(np.int64)
    return np.nonzero(common * q >= (sizes[0][:, None] + sizes[1][None, :] - common) * p)


def _grid(split: DataFrame, heavy: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links that connect what near copies of the heavy groups connect. split: (band, node, part); heavy: (band, largest, large, small).

    The members of a group's largest part are dealt to `large` blocks, all others to `small` ones; blocks of others meet each other and those of the largest part.
    """
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    blocks = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    cell = lambda kind, x, y, second: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), second.alias("second"))
    others = F.transform(blocks("small"), lambda j: cell(0, F.least(at("small"), j), F.greatest(at("small"), j), at("small") > j))
    first = F.transform(blocks("large"), lambda j: cell(1, at("small"), j, F.lit(False)))
    second = F.transform(blocks("small"), lambda i: cell(1, i, at("large"), F.lit(True)))
    members = split.join(heavy, "band")
    cells = members.select("band", "node", F.explode(F.when(F.col("part") == F.col("largest"), second).otherwise(F.concat(others, first))).alias("cell"))
    whole = cells.select("band", "node", "cell.*").join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        node, second = group.column("node").to_numpy(), group.column("second").to_numpy()
        held = [np.frombuffer(s.as_buffer(), np.uint32) for chunk in group.column("shingles").chunks for s in chunk]
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        b = b if len(b) else a  # a block with itself
        if not len(a):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        i, j = _alike([held[k] for k in a], [held[k] for k in b])
        root = forest(len(node), iter([(a[i], b[j])]))
        linked = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"u": node[root[linked]], "v": node[linked]})

    return checkpointed(whole.groupBy("band", "kind", "x", "y").applyInArrow(compare, "u long, v long"))


def _heavy(parts: DataFrame) -> DataFrame:
    """(band, largest, large, small) of the groups whose blocks carry much less than their pairs. parts: (band, part, n, bytes)."""
    top = F.max(F.struct("n", "part", "bytes")).alias("top")
    n = F.col("n").cast("double")
    groups = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), F.sum("bytes").alias("bytes"), top).where("parts > 1")
    blocks = lambda b: F.greatest(F.ceil(b / BLOCK_BYTES), F.lit(1))
    large, rest = F.col("top.bytes"), F.col("bytes") - F.col("top.bytes")
    sized = groups.select("*", blocks(large).alias("large"), blocks(rest).alias("small"))
    by_blocks = rest * (F.col("large") + F.col("small")) + large * F.col("small")
    by_pairs = (F.col("n") * F.col("n") - F.col("squares")) * F.col("bytes") / F.col("n")
    return sized.where(by_blocks * FEWER < by_pairs).select("band", F.col("top.part").alias("largest"), "large", "small")


def _between_nodes(proposed: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of rows as pairs of the first rows of their sets, u < v."""
    node_of = own.select("row", "same").join(nodes.select("same", "node"), "same").select("row", "node")
    ends = proposed.join(node_of.select(F.col("row").alias("u"), F.col("node").alias("a")), "u").join(node_of.select(F.col("row").alias("v"), F.col("node").alias("b")), "v")
    return ends.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_copies(rows: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(row, kept) for each row of rows (row, doc_id, text; row is distinct and the table is written, so that it reads the same again).

    kept is the row that stays for its component: the one of the smallest doc_id, nulls last, then of the smallest row number.
    proposed: pairs of rows (u, v) that may be near copies; those that their sets confirm are one before the bands are looked at.
    """
    own = checkpointed(signatures(rows))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    nodes = checkpointed(own.groupBy("same").agg(F.min("row").alias("node"), best, F.first("bands").alias("bands")))
    placed = nodes.select("node", F.explode("bands").alias("band"))
    many = placed.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    groups = checkpointed(placed.join(many, "band"))
    n = groups.count()
    known = checkpointed(_between_nodes(proposed, own, nodes)) if proposed is not None else None
    ends = groups.select("node")
    if known is not None:
        ends = ends.union(known.select("u")).union(known.select("v"))
    # whole sets of the rows that are in some pair, and of few others
    sets = dealt(_sets(may_hold(rows, "row", ends, "node").where("may")), "node")
    stars = _near(known, sets, known.count()) if known is not None else None
    # a node is first compared with the smallest of its bands' smallest nodes, then with those that it is not yet one with
    partners = groups.where("node != least").groupBy("node").agg(F.min("least").alias("least"))
    for pairs in (partners, groups.where("node != least").select("least", "node").distinct()):
        pairs = pairs.select(F.col("least").alias("u"), F.col("node").alias("v"))
        if stars is not None:
            one = components(stars)
            at = pairs.join(one.select(F.col("node").alias("u"), F.col("root").alias("p")), "u", "left").join(one.select(F.col("node").alias("v"), F.col("root").alias("q")), "v", "left")
            pairs = at.where(F.coalesce("p", "u") != F.coalesce("q", "v")).select("u", "v")
        found = _near(pairs, sets, n)
        stars = found if stars is None else stars.union(found)
    roots = components(stars).withColumnRenamed("root", "part")
    split = checkpointed(few(groups.join(roots, "node", "left").select("band", "node", F.coalesce("part", "node").alias("part")), n))
    sized = split.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    parts = checkpointed(few(sized.groupBy("band", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), n))
    heavy = checkpointed(few(_heavy(parts), n))
    stars = stars.union(_grid(split, heavy, sets))
    parts = parts.join(heavy, "band", "left_anti").select("band", "part")
    crossed = parts.join(parts.select("band", F.col("part").alias("other")), "band").where("part < other")
    left, right = split.select("band", "part", F.col("node").alias("a")), split.select("band", F.col("part").alias("other"), F.col("node").alias("b"))
    pairs = crossed.join(left, ["band", "part"]).join(right, ["band", "other"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    pairs = checkpointed(pairs)
    joined = components(stars.union(_near(pairs, sets, pairs.count())))
    rooted = nodes.join(joined, "node", "left").select("same", "best", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.row").alias("kept"))
    return own.select("row", "same").join(rooted.join(kept, "root").select("same", "kept"), "same").select("row", "kept")
