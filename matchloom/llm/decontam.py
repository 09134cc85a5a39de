"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is `window` consecutive words of an item (a shorter item is one window). Its shingles are ordered by rarity: the number of
documents that hold each. A document that contains a window has all of its shingles, so the rarest alone is the prefix that
must be joined. A match of that shingle at word p of a document, and at word k of the window, gives the only place where the window can
stand, p - k; it is dropped unless the window lies inside the document (positional and length bounds), and then checked
word by word. Items are worked on in blocks of bounded size. One block, the usual case, is broadcast and answers in one scan, and nothing is
shuffled. More blocks are worked on one after the other, so that driver and executors hold one at a time: each sends, for documents with
occurrences alone, the words and items it found, which are then gathered by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed
from .words import ALNUM, Texts, column_bytes, cover, per_text, runs, slices

WINDOW, SHINGLE = 10, 5
#: Words of items in a block, which bounds what is broadcast and held (about 200 bytes a word).
BLOCK_WORDS = 500_000


@dataclass
class Block:
    """Windows of some items. Window w is `size[w]` words from word `first[w]` of the block's words."""

    items: list[str]
    item: np.ndarray  # of each window
    first: np.ndarray
    size: np.ndarray
    full: np.ndarray  # hash of the whole window
    text: bytes  # words of all items, one space apart
    starts: np.ndarray  # bounds of the words in text
    ends: np.ndarray
    shingles: dict[int, np.ndarray]  # by length: sorted distinct hashes
    hashes: dict[int, np.ndarray]  # by length: of the shingle from each word on
    key: np.ndarray | None = None  # of each window, once rarity is known: its rarest shingle
    key_at: np.ndarray | None = None  # and its place in the window

    def spelt(self, w: int) -> bytes:
        return self.text[self.starts[self.first[w]] : self.ends[self.first[w] + self.size[w] - 1]]


def make_block(ids: list[str], texts: list[str], window: int, shingle: int) -> Block:
    column = pa.array([t.encode() for t in texts], pa.binary())
    raw, offsets = column_bytes(column)
    t = Texts(raw, offsets, ALNUM, lower=True)
    h, room, n = t.hashes(), t.room(), t.n_words
    item, first, size = [], [], []
    for d, k in enumerate(n.tolist()):
        for s in range(max(1, k - window + 1) if k else 0):
            item.append(d)
            first.append(int(t.first[d]) + s)
            size.append(min(window, k))
    item, first, size = (np.array(x, np.int64) for x in (item, first, size))
    full = np.zeros(len(size), np.uint64)
    shingles = {}
    for k in np.unique(size).tolist():
        own = runs(h, k)
        full[size == k] = own[first[size == k]]
    for k in np.unique(np.minimum(size, shingle)).tolist():
        own = runs(h, k)
        ok = np.flatnonzero(room[: len(own)] >= k)
        shingles[k] = np.unique(own[ok])
    spelt = b" ".join(t.word(i) for i in range(len(t.starts)))
    lengths = t.ends - t.starts
    ends = np.cumsum(lengths + 1) - 1
    return Block(ids, item, first, size, full, spelt, ends - lengths, ends, shingles, {k: runs(h, k) for k in shingles})


def order_by_rarity(block: Block, seen: dict[int, np.ndarray], shingle: int) -> None:
    """Sets the rarest shingle of each window (the first among equals); seen: documents that hold each of block.shingles. Windows that no document can contain go."""
    key, at, rare = np.zeros(len(block.size), np.uint64), np.zeros(len(block.size), np.int64), np.full(len(block.size), np.iinfo(np.int64).max)
    for k, own in block.hashes.items():
        mine = np.flatnonzero(np.minimum(block.size, shingle) == k)
        counts = np.zeros(len(own), np.int64)
        where = np.searchsorted(block.shingles[k], own)
        where = np.minimum(where, len(block.shingles[k]) - 1)
        counts[:] = seen[k][where]
        for j in range(int((block.size[mine] - k).max()) + 1 if len(mine) else 0):
            here = mine[block.size[mine] - k >= j]
            c = counts[block.first[here] + j]
            less = c < rare[here]
            rare[here[less]], at[here[less]], key[here[less]] = c[less], j, own[block.first[here[less]] + j]
    block.hashes = {}
    keep = rare > 0
    for name in ("item", "first", "size", "full"):
        setattr(block, name, getattr(block, name)[keep])
    block.key, block.key_at = key[keep], at[keep]


class Lookup:
    """Places in an array of hashes that hold one of `keys` (sorted): a table of their top bits comes first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.may = np.zeros(1 << 20, bool)
        self.may[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which key)"""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.flatnonzero(self.may[(hashes >> np.uint64(44)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.keys, hashes[places]), len(self.keys) - 1)
        ok = self.keys[which] == hashes[places]
        return places[ok], which[ok]


def _counted(docs: DataFrame, shared) -> DataFrame:
    """(size, shingle, n): in how many texts each shingle of the block occurs."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("size", "shingle", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shared.value.shingles
        lookups = {k: Lookup(keys) for k, keys in shingles.items()}
        totals = {k: np.zeros(len(keys), np.int64) for k, keys in shingles.items()}
        for batch in batches:
            for _, _, t in slices(batch.column(0), ALNUM, lower=True):
                h, room, owner = t.hashes(), t.room(), t.owner()
                for k, keys in shingles.items():
                    places, which = lookups[k].find(runs(h, k))
                    ok = room[places] >= k
                    pairs = np.unique(owner[places[ok]].astype(np.int64) * len(keys) + which[ok])
                    totals[k] += np.bincount(pairs % len(keys), minlength=len(keys))
        for k, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], names=schema.names)

    return docs.select("text").mapInArrow(run, schema).groupBy("size", "shingle").agg(F.sum("n").alias("n"))


def _ordered(docs: DataFrame, block: Block, shingle: int):
    """The block, its windows ordered by rarity, as a broadcast. The counts that come back are one a shingle of the block at most."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(block)
    counts = {k: np.zeros(len(keys), np.int64) for k, keys in block.shingles.items()}
    for row in _counted(docs, shared).toLocalIterator():
        counts[row["size"]][row["shingle"]] = row["n"]
    shared.destroy()
    order_by_rarity(block, counts, shingle)
    block.shingles = {}
    return sc.broadcast(block)


def blocks_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, id_column: str = "item_id", text_column: str = "text") -> Iterator[Block]:
    """Blocks of at most about block_words words, streamed from the item table; rows with a null id or text are left out."""
    ids, texts, n = [], [], 0
    for row in items.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("string"), F.col(text_column)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        n += 1 + len(row[1]) // 4
        if n >= block_words:
            yield make_block(ids, texts, window, shingle)
            ids, texts, n = [], [], 0
    if ids:
        yield make_block(ids, texts, window, shingle)


def matches(t: Texts, block: Block, look: Lookup, order: np.ndarray, bounds: np.ndarray, made: dict[int, np.ndarray], h: np.ndarray, room: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the texts, window) of every true occurrence."""
    starts, windows = [], []
    for k in np.unique(np.minimum(block.size, shingle)).tolist():
        if k not in made:
            made[k] = runs(h, k)
        places, which = look.find(made[k])
        n = bounds[which + 1] - bounds[which]
        p = np.repeat(places, n)
        w = order[np.repeat(bounds[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = p - block.key_at[w]
        ok = (np.minimum(block.size[w], shingle) == k) & (start >= 0)
        start, w, p = start[ok], w[ok], p[ok]
        ok = (room[start] >= block.size[w]) & (room[start] - room[p] == p - start)  # inside one text
        starts.append(start[ok])
        windows.append(w[ok])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, w = np.concatenate(starts), np.concatenate(windows)
    ok = np.zeros(len(start), bool)
    for k in np.unique(block.size[w]).tolist():
        mine = np.flatnonzero(block.size[w] == k)
        if k not in made:
            made[k] = runs(h, k)
        ok[mine] = made[k][start[mine]] == block.full[w[mine]]
    start, w = start[ok], w[ok]
    same = np.fromiter((all(t.buf[t.starts[s + j] : t.ends[s + j]].tobytes() == x for j, x in enumerate(block.spelt(v).split(b" "))) for s, v in zip(start.tolist(), w.tolist(), strict=True)), bool, len(start))
    return start[same], w[same]


class _Ready:
    """A block as a task uses it: made once a task."""

    def __init__(self, block: Block, shingle: int):
        self.block, self.shingle = block, shingle
        self.order = np.argsort(block.key, kind="stable")
        keys, first = np.unique(block.key[self.order], return_index=True)
        self.look, self.bounds = Lookup(keys), np.append(first, len(self.order))

    def found(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) of every occurrence."""
        return matches(t, self.block, self.look, self.order, self.bounds, {}, t.hashes(), t.room(), self.shingle)

    def hit(self, start: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        for k in np.unique(self.block.size[w]).tolist():
            out |= cover(start[self.block.size[w] == k], k, n)
        return out

    def items(self, t: Texts, start: np.ndarray, w: np.ndarray) -> list[set[str]]:
        out: list[set[str]] = [set() for _ in range(len(t.offsets) - 1)]
        for d, i in np.unique(np.column_stack([t.owner()[start], self.block.item[w]]), axis=0).tolist():
            out[d].add(self.block.items[i])
        return out


_FOUND = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("item_ids", T.ArrayType(T.StringType())))]


def _columns(n_words: np.ndarray, n_hit: np.ndarray, found: list[set[str]]) -> list[pa.Array]:
    ids = [sorted(f) for f in found]
    digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(i) for i in ids], pa.int64()), pa.array(digests), pa.array(n_hit > 0), pa.array(ids, pa.list_(pa.string()))]


def _one_scan(docs: DataFrame, shared, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """The result where there is one block, or none."""
    schema = T.StructType([docs.schema[c] for c in keep] + _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _Ready(shared.value, shingle) if shared is not None else None
        for batch in batches:
            for lo, hi, t in slices(batch.column(batch.num_columns - 1), ALNUM, lower=True):
                n_hit, found = np.zeros(hi - lo, np.int64), [set()] * (hi - lo)
                if ready is not None:
                    start, w = ready.found(t)
                    n_hit, found = per_text(ready.hit(start, w, len(t.starts)), t.first), ready.items(t, start, w)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *_columns(t.n_words, n_hit, found)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("text__")).mapInArrow(run, schema)


def _hits_of(rows: DataFrame, shared, shingle: int) -> DataFrame:
    """(row, words, items) of rows (row, text) with occurrences: places of the words that are hit, packed, and the items."""
    schema = "row long, words binary, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _Ready(shared.value, shingle)
        for batch in batches:
            for lo, _, t in slices(batch.column(1), ALNUM, lower=True):
                start, w = ready.found(t)
                hit, found = ready.hit(start, w, len(t.starts)), ready.items(t, start, w)
                some = [d for d, f in enumerate(found) if f]
                if some:
                    words = [np.flatnonzero(hit[t.first[d] : t.first[d + 1]]).astype("<i8").tobytes() for d in some]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + d for d in some])), pa.array(words, pa.binary()), pa.array([sorted(found[d]) for d in some], pa.list_(pa.string()))], names=["row", "words", "items"])

    return rows.mapInArrow(run, schema)


def _many_blocks(docs: DataFrame, blocks: Iterator[Block], shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """The result over any number of blocks, one after the other."""
    own = checkpointed(docs.select(F.monotonically_increasing_id().alias("row__"), *keep, F.col("text").alias("text__")))
    rows, hits = own.select(F.col("row__").alias("row"), F.col("text__").alias("text")), None
    for block in blocks:
        shared = _ordered(rows, block, shingle)
        part = checkpointed(_hits_of(rows, shared, shingle))
        shared.destroy()
        hits = part if hits is None else hits.union(part)
    gathered = hits.groupBy("row").agg(F.collect_list("words").alias("words__"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items__"))
    schema = T.StructType([docs.schema[c] for c in keep] + _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            for lo, hi, t in slices(batch.column(n), ALNUM, lower=True):
                words, items = (batch.column(n + 1 + k).slice(lo, hi - lo).to_pylist() for k in (0, 1))
                n_hit = np.array([len(np.unique(np.frombuffer(b"".join(w), "<i8"))) if w else 0 for w in words], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(n)), *_columns(t.n_words, n_hit, [set(i or ()) for i in items])], names=schema.names)

    return own.join(gathered, own["row__"] == gathered["row"], "left").select(*keep, "text__", "words__", "items__").mapInArrow(run, schema)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: the `keep` columns, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    n_hit: words inside any occurrence of a window; item_ids: the items with occurrences, as sorted strings. Null and empty texts have no
    words and no hits; so has every text where the item table is empty. Repeated rows give repeated results; equal windows of several items count
    for each item; items with equal ids are one; other columns play no part.
    """
    blocks = blocks_of(items, window, shingle, block_words)
    first = next(blocks, None)
    second = next(blocks, None)
    if second is not None:
        return _many_blocks(docs, chain([first, second], blocks), shingle, keep)
    return _one_scan(docs, _ordered(docs, first, shingle) if first is not None else None, shingle, keep)


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """The same by plain search, for tests: id -> (n_words, n_hit, sorted item ids)."""
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda s: word.findall((s or "").encode().lower())
    out = {}
    for d, text in texts.items():
        ws, hit, found = split(text), set(), set()
        for i, item in items.items():
            own = split(item)
            k = min(window, len(own))
            for wdw in {tuple(own[s : s + k]) for s in range(len(own) - k + 1)} if own else ():
                for p in range(len(ws) - k + 1):
                    if tuple(ws[p : p + k]) == wdw:
                        hit.update(range(p, p + k))
                        found.add(str(i))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


def oracle(window: int = WINDOW) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w, least({window}, len({words})) AS k FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS ws FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS ws FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT rid, i, k, item_id FROM dw JOIN iw USING (k, ws)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""
