"""SimHash near-dedup: fingerprints by a bitwise majority, linked by a self-join of their binary trie.

The trie of the distinct fingerprints is walked against itself from the root: a pair of nodes carries the bits in which their
prefixes differ, and goes once they are more than the budget. Near the root the walk is a join of prefix tables, a few bits a
step, over nodes that hold too many fingerprints; a pair of nodes that hold few enough becomes one task, which walks on from there, with what is left of the
budget, down the two sorted arrays. A node travels as one row of packed fingerprints, eight bytes each. There are at most sum(C(64, i) for i up to the
budget) links a fingerprint since equal ones are one, and a task sends a spanning forest of its links, not the links.

near_copies is for sets of five-word shingles of similarity 0.8 or more: links of the trie are proposals that the whole sets confirm, and what 64 bits cannot
see within a budget that a trie can walk is proposed by bands of minima (nearsets) among the rows that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nearsets
from .graph import components, forest
from .session import checkpointed
from .words import LOWER, column_bytes, release

SHINGLE, BUDGET, SEED = 3, 2, 42
#: Fingerprints a node may hold in a task, bits a step of the walk by joins, and the share of rows from which on a fingerprint is hot.
NODE_CAP, STEP, HOT = 32_768, 2, 1000

#: For a byte, its bits from the highest on as eight counters of one byte.
_LANES = np.array([sum(((v >> (7 - i)) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For the 64-bit values first[d] to first[d+1] of each d: the bits set in over half of them; 0 for none."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    # one-byte counters hold 255, so longer runs are counted in parts
    parts = -(-sizes[some] // 255)
    part_of = np.repeat(np.arange(len(some)), parts)
    start = np.repeat(first[:-1][some], parts) + (np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)) * 255
    lanes = _LANES[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, start, axis=0).view(np.uint8).reshape(len(start), 64)
    totals = np.add.reduceat(counts.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = totals * 2 > sizes[some][:, None]
    out[some] = np.packbits(bits, axis=1).reshape(-1, 8).copy().view(">u8").reshape(-1).astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """(id, fp) for each row of docs; fp is the fingerprint as a signed long. Texts of fewer words are one shingle, texts without words have fp 0."""
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest

        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, side="right")) - 1)
                lower = LOWER[raw[offsets[lo] : offsets[hi]]].tobytes()
                digests, sizes = [], []
                for i in range(lo, hi):
                    words = lower[offsets[i] - offsets[lo] : offsets[i + 1] - offsets[lo]].split()
                    if len(words) >= shingle:
                        digests += [xxh64_digest(s, seed) for s in map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False))]
                    elif words:
                        digests.append(xxh64_digest(b" ".join(words), seed))
                    sizes.append(len(digests))
                h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
                fp = majority(h, np.concatenate([[0], sizes]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=schema.names)
                lo = hi
            release()

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def walk(a: np.ndarray, b: np.ndarray, own: bool, budget: int, bits: int = 0, spent: int = 0, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of pairs within the budget, chunk by chunk. a and b are sorted; own: they are the same array, and a pair comes once.

    bits: how many leading bits are equal within a and within b; spent: in how many of them a and b differ.
    """
    top = np.uint64(63)
    todo = [(bits, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([budget - spent]), np.array([own]))] if len(a) and len(b) and spent <= budget else []
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while todo:
        bit, a0, a1, b0, b1, left, same = todo.pop()
        few = ((a1 - a0) * (b1 - b0) <= 4) | (bit == 64)
        if few.any():
            x, y = _expand(a0[few], a1[few], b0[few], b1[few])
            ok = np.bitwise_count(a[x] ^ b[y]) <= budget
            if own:
                ok &= x < y
            if ok.any():
                yield x[ok], y[ok]
            a0, a1, b0, b1, left, same = (v[~few] for v in (a0, a1, b0, b1, left, same))
        if not len(a0):
            continue
        if bit not in zeros:
            zeros[bit] = tuple(np.concatenate([[0], np.cumsum((v >> (top - np.uint64(bit)) & np.uint64(1)) == 0)]) for v in (a, b))
        za, zb = zeros[bit]
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        parts = [(a0, am, b0, bm, left, same), (am, a1, bm, b1, left, same), (a0, am, bm, b1, left - 1, np.zeros_like(same))]
        other = ~same  # of a node with itself, the two crossed pairs are one
        parts.append(tuple(v[other] for v in (am, a1, b0, bm, left - 1, same)))
        joined = [np.concatenate(v) for v in zip(*parts, strict=True)]
        alive = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] >= 0)
        joined = [v[alive] for v in joined]
        for i in range(0, len(joined[0]), chunk):
            todo.append((bit + 1, *(v[i : i + chunk] for v in joined)))


def _expand(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[which] + k // nb[which], b0[which] + k % nb[which]


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 64 - bits)


def _leaves(fps: DataFrame, budget: int, cap: int) -> list[tuple[int, DataFrame]]:
    """Node pairs that need no further step, as (bits, pairs of prefixes p <= q); the walk by joins."""
    done, bits = [], STEP
    counts = fps.groupBy(_prefix(bits).alias("p")).count()
    other = counts.select(F.col("p").alias("q"), F.col("count").alias("count_q"))
    pairs = counts.join(other, (F.col("p") <= F.col("q")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= budget))  # at most 2**STEP rows a side
    while True:
        pairs = checkpointed(pairs)
        wide = (F.col("count") > cap) | (F.col("count_q") > cap)
        done.append((bits, (pairs.where(~wide) if bits < 64 else pairs).select("p", "q")))
        open_pairs = pairs.where(wide)
        if bits == 64 or open_pairs.isEmpty():
            return done
        bits += STEP
        counts = checkpointed(fps.groupBy(_prefix(bits).alias("c")).count())
        left = counts.select(F.shiftrightunsigned("c", STEP).alias("p"), F.col("c").alias("cp"), F.col("count").alias("n"))
        right = counts.select(F.shiftrightunsigned("c", STEP).alias("q"), F.col("c").alias("cq"), F.col("count").alias("m"))
        down = open_pairs.select("p", "q").join(left, "p").join(right, "q").where((F.col("cp") <= F.col("cq")) & (F.bit_count(F.col("cp").bitwiseXOR(F.col("cq"))) <= budget))
        pairs = down.select(F.col("cp").alias("p"), F.col("n").alias("count"), F.col("cq").alias("q"), F.col("m").alias("count_q"))


def _nodes(fps: DataFrame, bits: int, wanted: DataFrame) -> DataFrame:
    """(own, node): the sorted fingerprints of each wanted prefix, packed."""

    def pack(group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy().view(np.uint64))
        return pa.table({"own": pa.array([group.column("own")[0].as_py()], pa.int64()), "node": pa.array([fp.tobytes()], pa.binary())})

    return fps.select("fp", _prefix(bits).alias("own")).join(wanted, "own", "left_semi").groupBy("own").applyInArrow(pack, "own long, node binary")


def links(fps: DataFrame, budget: int = BUDGET, cap: int = NODE_CAP) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints that chains of links within the budget connect. fps: distinct longs in column fp."""
    found = None
    for bits, pairs in _leaves(fps, budget, cap):

        def task(batches: Iterator[pa.RecordBatch], bits: int = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, q, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    own = p == q
                    a = np.frombuffer(x.as_buffer(), np.uint64)
                    b = a if own else np.frombuffer(y.as_buffer(), np.uint64)
                    both = a if own else np.concatenate([a, b])
                    root = forest(len(both), ((i, j if own else j + len(a)) for i, j in walk(a, b, own, budget, bits, (p ^ q).bit_count())))
                    at = np.flatnonzero(root != np.arange(len(both)))
                    yield pa.RecordBatch.from_arrays([pa.array(both[at].view(np.int64)), pa.array(both[root[at]].view(np.int64))], names=["u", "v"])

        ends = pairs.select(F.explode(F.array("p", "q")).alias("own")).distinct()
        nodes = checkpointed(_nodes(fps, bits, ends))
        sides = pairs.join(nodes.select(F.col("own").alias("p"), F.col("node").alias("a")), "p").join(nodes.select(F.col("own").alias("q"), F.col("node").alias("b")), "q")
        # dealt by pair, so that the pairs of one node are walked in several tasks; a node with itself needs one side
        dealt = sides.select("p", "q", "a", F.when(F.col("p") != F.col("q"), F.col("b")).alias("b")).repartition(F.xxhash64("p", "q"))
        part = dealt.mapInArrow(task, "u long, v long")
        found = part if found is None else found.union(part)
    return found


def _by_fingerprint(own: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """own (with fp) and the columns of answers (fp, n, columns), where n counts the rows of own with that fingerprint.

    Fingerprints of a thousandth of all rows, of which there are a thousand at most, are broadcast; the others are joined by a shuffle.
    """
    most = (own.count() // HOT) + 1
    hot = F.broadcast(answers.where(F.col("n") >= most).select("fp", *columns, F.lit(True).alias("hot")))
    marked = own.join(hot, "fp", "left")
    rest = marked.where("hot is null").select(*own.columns).join(answers.where(F.col("n") < most).select("fp", *columns), "fp")
    return marked.where("hot").select(*own.columns, *columns).unionByName(rest.select(*own.columns, *columns))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", cap: int = NODE_CAP) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null, empty and wordless texts have fingerprint zero and link like any other. Null ids are no smallest id; a component of null ids alone has
    a null id. Repeated rows give repeated results; an empty table gives no rows; other columns play no part.
    """
    own = checkpointed(fingerprints(docs, shingle, seed, id_column, text_column))
    least = checkpointed(own.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")))
    joined = components(links(least.select("fp"), budget, cap))
    roots = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = checkpointed(roots.join(smallest, "root").select("fp", "n", "component_id"))
    return _by_fingerprint(own, answers, ["component_id"]).select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(rows: DataFrame, budget: int = 3, cap: int = NODE_CAP) -> DataFrame:
    """(row, kept) for each row of rows (row, doc_id, text; row is distinct and the table is written, so that it reads the same again).

    Texts are linked if their sets of five-word shingles (A-Z in lower case) are at least 0.8 alike, and by chains of such links. kept is the row that stays for
    its group: the one of the smallest doc_id, nulls last, then of the smallest row number. Texts without words are one group. A link of the
    trie stands only if the sets of both fingerprints' first rows confirm it, and rows of one fingerprint count as one set only if their sets are equal.
    """
    own = checkpointed(fingerprints(rows, nearsets.SHINGLE, SEED, "row", "text"))
    first = checkpointed(own.groupBy("fp").agg(F.min("row").alias("row")))
    linked = links(first.select("fp"), budget, cap).distinct()
    pairs = linked.join(first.select(F.col("fp").alias("u"), F.col("row").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("row").alias("b")), "v")
    return nearsets.near_copies(rows, pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def brute_force(texts: list[tuple], shingle: int = SHINGLE, budget: int = BUDGET) -> list[tuple]:
    """(id, fingerprint, component) by plain comparison of all pairs, for tests."""
    import xxhash

    fps = []
    for i, t in texts:
        ws = (t or "").encode().lower().split()
        sh = [b" ".join(ws[p : p + shingle]) for p in range(len(ws) - shingle + 1)] or ([b" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s, SEED) for s in sh]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    distinct = np.array(sorted({f for _, f in fps}), np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    at = {int(f): find(k) for k, f in enumerate(distinct)}
    least: dict[int, int] = {}
    for i, f in fps:
        if i is not None:
            least[at[f]] = min(least.get(at[f], i), i)
    return [(i, f"{f:016x}", least.get(at[f])) for i, f in fps]
