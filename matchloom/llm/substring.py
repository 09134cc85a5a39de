"""Substring dedup by difference-cover anchors.

Every window of `window` words whose words also start in a document with a smaller id goes. Windows are not shuffled at every word: with the
difference cover {1, 2, 4} of the period 7, any two equal runs of 13 words have an offset at which both stand at cover
positions of their own documents, and there they share a 7-word anchor. So anchors at cover positions are compared first, in 3 of 7 places; only
windows that hold an anchor found in two rows are extended to all 13 words and compared by 96 bits: of two run hashes that have different bases and
rest on two independent hashes of every word (of its bytes, eight at a time, none of them a polynomial).

Documents travel in blocks of a few megabytes, dealt by block and written once to the shared checkpoint folder; joins with the blocks' answers keep that
dealing, so the texts are shuffled once. A block sends, for each bucket of hash values, its distinct values in order, as differences (a passage
common to many documents is thus one value a block), and gets back one bit for each. The number of buckets follows from the bytes of all texts, without a
bound; a block's message to a bucket has a fixed part of about 100 bytes, which outweighs its values beyond about a terabyte of text: larger blocks move that point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed, dealt
from .words import RUN_BASE_2, SPACE, Texts, column_bytes, cover, per_text, release, runs

#: A perfect difference set: every difference modulo PERIOD is one of two of its members.
PERIOD, COVER = 7, (1, 2, 4)
BLOCK_BYTES, BUCKET_VALUES = 4 << 20, 400_000
#: Bits of an anchor's hash that are not sent: anchors only propose, and 48 bits let few strangers in.
ANCHOR_CUT = np.uint64(16)
SECOND = 0x2545F491
_LOW32, _32 = np.uint64((1 << 32) - 1), np.uint64(32)
_CODEC = "zstd"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit values, byte by byte of all values, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return pa.compress(raw, codec=_CODEC, asbytes=True)


def _unplanes(packed: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, n * width, codec=_CODEC, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def _gaps(sorted_values: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_values, prepend=np.uint64(0)), 8)


def _ungaps(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(packed, n, 8), dtype=np.uint64)


def blocks_of(docs: DataFrame, columns: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block_id, bytes, payload): rows of docs in Arrow form, compressed; a row is never cut."""
    schema = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = column_bytes(batch.column(at))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, side="right")) - 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
                    out.write_batch(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([int(offsets[hi] - offsets[lo])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=schema.names)
                lo, k = hi, k + 1

    return docs.select(*columns).mapInArrow(run, schema)


class Block:
    """The rows of a block, their words, and the hash values it compares with other blocks."""

    def __init__(self, payload: bytes, window: int, id_column: str):
        self.table = pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()
        self.rows = self.table[0]
        self.window = window
        self.raw, offsets = column_bytes(self.rows.column("text"))
        self.texts = Texts(self.raw[offsets[0] : offsets[-1]], offsets - offsets[0], SPACE, lower=False)
        ids = self.rows.column(id_column)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.h = self.texts.hashes()
        self.room = self.texts.room()
        self.owner = self.texts.owner()

    def anchors(self) -> None:
        """Distinct anchors in order: self.anchor, whether two rows of the block hold it, and the word of each occurrence."""
        k = self.window - PERIOD + 1
        own = runs(self.h, k)
        place = (np.arange(len(own)) - self.texts.first[self.owner[: len(own)]]) % PERIOD
        long = self.texts.n_words[self.owner] >= self.window
        at = np.flatnonzero(np.isin(place, COVER) & (self.room[: len(own)] >= k) & long[: len(own)] & self.known[self.owner[: len(own)]])
        key = own[at] >> ANCHOR_CUT
        order = np.argsort(key, kind="stable")
        self.anchor_word = at[order]
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.anchor_of = np.cumsum(new) - 1
        self.anchor = key[new]
        first = self.owner[self.anchor_word[new]]
        self.anchor_many = np.zeros(len(self.anchor), bool)
        np.logical_or.at(self.anchor_many, self.anchor_of, self.owner[self.anchor_word] != first[self.anchor_of])

    def extend(self, shared: np.ndarray) -> None:
        """Distinct windows around shared anchors: self.win (64 bits), self.win2 (32 more, of other word hashes), the least id, and each occurrence."""
        n, reach = len(self.h), self.window - (self.window - PERIOD + 1)
        edge = np.zeros(n + 1, np.int64)
        words = self.anchor_word[shared[self.anchor_of]]
        np.add.at(edge, np.maximum(words - reach, 0), 1)
        np.add.at(edge, words + 1, -1)
        start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.room >= self.window) & self.known[self.owner])
        if len(start):
            key = runs(self.h, self.window)[start]
            b = runs(self.texts.hashes(SECOND), self.window, RUN_BASE_2)[start] & _LOW32
        else:
            key = b = np.zeros(0, np.uint64)
        order = np.lexsort((b, key))
        key, b, self.win_start = key[order], b[order], start[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (b[1:] != b[:-1])
        self.win_of = np.cumsum(new) - 1
        self.win, self.win2 = key[new], b[new]
        self.win_least = np.full(len(self.win), np.iinfo(np.int64).max)
        np.minimum.at(self.win_least, self.win_of, self.ids[self.owner[self.win_start]])

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words go; smaller: windows that start in a smaller document of another block."""
        own = self.ids[self.owner[self.win_start]]
        gone = smaller[self.win_of] | (own > self.win_least[self.win_of])
        return cover(self.win_start[gone], self.window, len(self.h))


def _sent(values: np.ndarray, bits: int, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values of so many bits; buckets are equal ranges of the values."""
    bucket = ((values >> np.uint64(bits - 32)) * np.uint64(n_buckets) >> _32).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cut.tolist(), len(values)]
    return [(int(bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


_ENTRY = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType())])
_REPLY = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ENTRY.names)


def _replies(blocks: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> pa.Table:
    """One row for each entry that has a mark."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = [(int(blocks[i]), int(buckets[i]), np.packbits(marks[edges[i] : edges[i + 1]]).tobytes()) for i in range(len(sizes)) if marks[edges[i] : edges[i + 1]].any()]
    return pa.table({"block_id": pa.array([r[0] for r in out], pa.int64()), "bucket": pa.array([r[1] for r in out], pa.int64()), "bits": pa.array([r[2] for r in out], pa.binary())})


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(group.column(c).to_numpy() for c in ("block_id", "bucket", "n"))


def _shared_anchors(group: pa.Table) -> pa.Table:
    """Marks of values that two rows hold, in one block or in two."""
    blocks, buckets, sizes = _columns(group)
    value = np.concatenate([_ungaps(a, n) for a, n in zip(group.column("a").to_pylist(), sizes.tolist(), strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(group.column("b").to_pylist(), sizes.tolist(), strict=True)])
    order = np.argsort(value, kind="stable")
    value = value[order]
    same = np.zeros(len(value), bool)
    same[1:] = value[1:] == value[:-1]
    same[:-1] |= same[1:]
    marks = many.copy()
    marks[order] |= same
    return _replies(blocks, buckets, sizes, marks)


def _smaller_elsewhere(group: pa.Table) -> pa.Table:
    """Marks of windows whose least id is larger than the least of all."""
    blocks, buckets, sizes = _columns(group)
    a = np.concatenate([_ungaps(x, n) for x, n in zip(group.column("a").to_pylist(), sizes.tolist(), strict=True)])
    b, c = (np.concatenate([_unplanes(x, n, w) for x, n in zip(group.column(k).to_pylist(), sizes.tolist(), strict=True)]) for k, w in (("b", 4), ("c", 8)))
    least = c.view(np.int64)
    order = np.lexsort((least, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    overall = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    marks = np.zeros(len(order), bool)
    marks[order] = least[order] > overall
    return _replies(blocks, buckets, sizes, marks)


def _marked(sent: list[tuple[int, int, int]], n: int, replies: list | None) -> np.ndarray:
    """The bits of the replies, in the order of the n values that were sent."""
    out = np.zeros(n, bool)
    bits = {r["bucket"]: r["bits"] for r in replies or ()}
    for bucket, a, b in sent:
        if bucket in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _told(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def dedup(docs: DataFrame, keep: list[str], finish: Callable[[Block, np.ndarray], pa.RecordBatch], schema: T.StructType, window: int = 13, id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """finish(block, removed words) for every block, as rows of `schema`.

    keep: columns of docs that finish needs, text and the integer id included. Null texts have no words; rows with a null id neither
    lose words nor make others lose them; rows of equal id do not compare with each other, as neither id is smaller. An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    blocks = dealt(blocks_of(docs, keep, block_bytes), "block_id")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    # a text has an anchor for about 14 of its bytes
    n_buckets = max(64, total // 14 // BUCKET_VALUES)

    def opened(payload: bytes) -> tuple[Block, list]:
        block = Block(payload, window, id_column)
        block.anchors()
        return block, _sent(block.anchor, 48, n_buckets)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, sent = opened(payload)
                if rows := [(k, block_id, b - a, _gaps(block.anchor[a:b]), np.packbits(block.anchor_many[a:b]).tobytes(), None) for k, a, b in sent]:
                    yield _entries(rows)
                del block, sent
            release()

    shared = blocks.select("block_id", "payload").mapInArrow(send_anchors, _ENTRY).groupBy("bucket").applyInArrow(_shared_anchors, _REPLY)
    shared = checkpointed(_told(shared, "anchors"))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload, replies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block, sent = opened(payload)
                block.extend(_marked(sent, len(block.anchor), replies))
                if rows := [(k, block_id, b - a, _gaps(block.win[a:b]), _planes(block.win2[a:b], 4), _planes(block.win_least[a:b], 8)) for k, a, b in _sent(block.win, 64, n_buckets)]:
                    yield _entries(rows)
                del block, sent
            release()

    smaller = blocks.join(shared, "block_id").select("block_id", "payload", "anchors").mapInArrow(send_windows, _ENTRY).groupBy("bucket").applyInArrow(_smaller_elsewhere, _REPLY)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, anchors, windows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if anchors:
                    block, sent = opened(payload)
                    block.extend(_marked(sent, len(block.anchor), anchors))
                    gone = block.removed(_marked(_sent(block.win, 64, n_buckets), len(block.win), windows))
                else:
                    block = Block(payload, window, id_column)
                    gone = np.zeros(len(block.h), bool)
                yield finish(block, gone)
                del block, gone
            release()

    answered = blocks.join(shared, "block_id", "left").join(_told(smaller, "windows"), "block_id", "left")
    return answered.select("payload", "anchors", "windows").mapInArrow(settle, schema)


def kept_bytes(block: Block, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Words removed, and the kept words joined by one space, of each text."""
    t = block.texts
    lost = per_text(gone, t.first)
    out = []
    for d, n in enumerate(lost.tolist()):
        words = t.raw[t.offsets[d] : t.offsets[d + 1]].tobytes().split()
        out.append(b" ".join(compress(words, (~gone[t.first[d] : t.first[d + 1]]).tolist()) if n else words))
    return lost, out


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256. Null and empty texts, null and repeated ids, and empty tables are as in dedup; other columns play no part."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        lost, kept = kept_bytes(block, gone)
        return pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(block.texts.n_words), pa.array(lost), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=schema.names)

    return dedup(docs, ["doc_id", "text"], finish, schema)


def cleaned(docs: DataFrame, keep: list[str], window: int = 13) -> DataFrame:
    """The `keep` columns with text less the removed words; a text that loses none stays byte for byte, n_chars follows the text."""
    schema = T.StructType([docs.schema[c] for c in keep])

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        lost, kept = kept_bytes(block, gone)
        columns = []
        for name in keep:
            own = block.rows.column(name)
            if name in ("text", "n_chars"):
                old = own.to_pylist()
                new = [k.decode("utf-8", "replace") for k in kept]
                own = pa.array([(n if name == "text" else len(n)) if x else o for o, n, x in zip(old, new, lost.tolist(), strict=True)], own.type)
            columns.append(own)
        return pa.RecordBatch.from_arrays(columns, names=keep)

    return dedup(docs, keep, finish, schema, window)


def brute_force(texts: list[tuple], window: int = 13) -> list[tuple]:
    """(id, words, removed, kept) by plain search, for tests."""
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            if i is not None:
                w = tuple(ws[p : p + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def oracle(window: int = 13) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, list_slice(w, i, i + {window - 1}) AS ws FROM (SELECT *, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window} AND doc_id IS NOT NULL)),
first AS (SELECT ws, min(doc_id) AS least FROM win GROUP BY ws HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {window})) AS p FROM win JOIN first USING (ws) WHERE doc_id > least),
ps AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
words AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d JOIN ps USING (rid))),
kept AS (SELECT words.rid, string_agg(word, ' ' ORDER BY i) AS t FROM words LEFT JOIN gone ON words.rid = gone.rid AND words.i = gone.p WHERE gone.p IS NULL GROUP BY words.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN ps USING (rid) LEFT JOIN kept USING (rid)"""
