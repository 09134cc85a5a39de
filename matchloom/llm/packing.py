"""Packing by vector bin packing with the dot-product heuristic.

Every example is a vector (tokens, segments, loss tokens) and every sequence has a limit for each. A sequence is filled by
taking, again and again, the example whose vector has the largest dot product with what is left of the limits (both as
shares of the limits), among those that fit. Examples with equal vectors are one class, so a choice looks at classes, not
at examples. Each task packs its own rows through a bounded buffer: nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memo import Memo
from .words import column_bytes, release

BUFFER = 4096
#: A task numbers its sequences from its partition times this.
SEQUENCES_A_PARTITION = 1 << 40


class Packer:
    """Fills sequences under three limits from a bounded buffer of examples.

    cut: examples are runs of tokens that may be cut anywhere; a sequence is then filled up by the head of one more example. Without it an
    example stays whole, and one beyond a limit gets a sequence of its own.
    """

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.cut = cut
        self.waiting: dict[tuple[int, int, int], deque] = defaultdict(deque)
        self.n = 0
        self._classes: np.ndarray | None = None

    def add(self, item, tokens: int, loss: int, segments: int = 1) -> None:
        queue = self.waiting[tokens, loss, segments]
        if not queue:
            self._classes = None
        queue.append(item)
        self.n += 1

    def _take(self, key: tuple[int, int, int]):
        queue = self.waiting[key]
        item = queue.popleft()
        self.n -= 1
        if not queue:
            del self.waiting[key]
            self._classes = None
        return item

    def _table(self) -> np.ndarray:
        if self._classes is None:
            keys = np.array(sorted(self.waiting), np.float64).reshape(-1, 3)
            self._classes = keys[:, [0, 2, 1]]
        return self._classes

    def sequence(self) -> list[tuple]:
        """One sequence as (item, tokens, loss, kept back) in order; with cut, the last may be the head of its item."""
        left, out = self.limits.copy(), []
        while self.n:
            table = self._table()
            fits = np.flatnonzero((table <= left).all(axis=1))
            if not len(fits):
                if not out and not self.cut:
                    key = max(self.waiting)
                    return [(self._take(key), key[0], key[1], 0)]
                if self.cut and left[0] >= 1 and left[1] >= 1 and left[2] >= 1:
                    key = max(self.waiting)
                    room = int(min(left[0], left[2]))
                    out.append((self._take(key), room, room, key[0] - room))
                break
            best = fits[np.argmax(table[fits] @ (left / self.limits**2))]
            tokens, loss = int(table[best, 0]), int(table[best, 2])
            out.append((self._take((tokens, loss, int(table[best, 1]))), tokens, loss, 0))
            left -= table[best]
            if not left.all():
                break
        return out


def pack_examples(examples: DataFrame, tokens: int, segments: int, loss: int, id_column: str = "example_id", tokens_column: str = "n_tokens", loss_column: str = "n_loss", segments_column: str | None = None, buffer: int = BUFFER) -> DataFrame:
    """Whole examples into sequences: id, sequence_id, position, offset (tokens before it there), oversize.

    An example is one segment, or as many as segments_column says. One beyond a limit stands alone and is marked oversize. Null counts are 0; an example of no tokens still takes its segments. Repeated
    ids are packed as rows of their own; an empty table gives no rows; other columns play no part.
    """
    schema = T.StructType([T.StructField(id_column, examples.schema[id_column].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("oversize", T.BooleanType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence, kind = Packer(tokens, segments, loss, cut=False), TaskContext.get().partitionId() * SEQUENCES_A_PARTITION, None

        def filled(down_to: int) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            while packer.n > down_to:
                at = 0
                for k, ((item, parts), size, bearing, _) in enumerate(packer.sequence()):
                    out.append((item, sequence, k, at, size > tokens or bearing > loss or parts > segments))
                    at += size
                sequence += 1
            if out:
                a, b, c, d, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.array(e, pa.bool_())], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for item, n, m, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packer.add((item, int(parts or 0)), int(n or 0), int(m or 0), int(parts or 0))
                if packer.n >= 2 * buffer:
                    yield from filled(buffer)
        yield from filled(0)

    parts = F.col(segments_column) if segments_column else F.lit(1)
    return examples.select(id_column, tokens_column, loss_column, parts.alias("segments__")).mapInArrow(run, schema)


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, from ids of words that are encoded once each.

    The byte-level tokenizer always begins a word at a space that stands before another character, and at a lone line feed between characters
    that are not white space. Texts where white space meets white space, or with special tokens in them, go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.apart = ["  ", "\n\n", " \n", "\n ", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.memo = Memo(self._words, 120_000)
        self.first = Memo(self._encode, 50_000)
        #: the same vocabulary and merges (an id is the rank of its merge) in a library that is faster on unknown words
        self.faster = self._ranked()
        #: which ids begin a word: those of tokens that begin with a space or a line feed
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True

    def _ranked(self):
        import tiktoken
        from public_tokenizers import PATTERN

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text and cut where a word begins; a word that is white space alone is encoded by itself."""
        plain = [w for w in words if w.strip()]
        ids = np.array(self.faster.encode_ordinary("".join([w if w[0] == "\n" else " " + w for w in plain])), "<u4")
        cuts = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
        packed = ids.tobytes()
        if len(plain) == len(words) == len(cuts) - 1:
            return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self._encode([w if w[:1] == "\n" else " " + w for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(s in t for s in self.apart) for t in texts]
        found = [t.replace("\n", " \n").split(" ") for t, p in zip(texts, plain, strict=True) if p]
        begins = self.first.resolve([[ws.pop(0) for ws in found]])[0]
        made = iter([b + b"".join(ids) for b, ids in zip(begins, self.memo.resolve(found), strict=True)])
        rest = iter(self._encode([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(made) if p else next(rest) for p in plain]


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    """One for all tasks of a Python worker, so that words stay known."""
    return WordIds(tokenizer_file)


def token_sizes(rows: DataFrame, tokenizer_file: str, keys: list[str], batch_bytes: int = 1 << 20) -> DataFrame:
    """The keys and n_tokens, the ids of a row's text and an end id; null texts are empty."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_file)
        for batch in batches:
            raw, offsets = column_bytes(batch.column(len(keys)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_bytes, side="right")) - 1)
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                sizes = [len(own) // 4 + 1 for own in ids.encode(texts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keys))), pa.array(sizes, pa.int64())], names=schema.names)
                lo = hi

    return rows.select(*keys, F.col("text").alias("text__")).mapInArrow(run, schema)


def pack_conversations(turns: DataFrame, tokenizer_file: str, tokens: int = 2048, segments: int = 32, loss: int = 1024) -> DataFrame:
    """Whole conversations into sequences, with limits on tokens, on turns and on the tokens of the assistant, which bear loss.

    turns: conv_id, role, text. One row a conv_id (rows of a null id are one): n_tokens, n_loss, n_turns and where it lies, as pack_examples says, segments being turns.
    Null texts are empty and null roles no assistant; the sums of a conversation are combined before their shuffle, however many turns it has.
    """
    # a file of few row groups is few tasks, which count tokens far longer than dealing the texts takes
    turns = turns.select("conv_id", "role", "text").repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = token_sizes(turns, tokenizer_file, ["conv_id", "role"])
    bearing = F.sum(F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(0)).alias("n_loss")
    sums = counted.groupBy("conv_id").agg(F.sum("n_tokens").alias("n_tokens"), bearing, F.count("*").alias("n_turns"))
    example = F.struct("conv_id", "n_tokens", "n_loss", "n_turns").alias("example")
    packed = pack_examples(sums.select(example, "n_tokens", "n_loss", "n_turns"), tokens, segments, loss, "example", segments_column="n_turns")
    return packed.select("example.*", "sequence_id", "position", "offset", "oversize")


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(docs: DataFrame, tokenizer_file: str, tokens: int = 1024, segments: int = 256, end_id: int = 0, buffer: int = BUFFER, batch_bytes: int = 1 << 20) -> DataFrame:
    """Whole documents (doc_id, text) as token pieces in sequences of at most `tokens` ids; every token bears loss here.

    A document's ids are followed by end_id; null and empty texts have only that. Full sequences are cut off a document first; the rest is
    packed by the heuristic, and cut to fill a sequence. The last sequence of a task is cut into sizes that are powers of two, which need no
    padding. Repeated rows are packed as documents of their own; an empty table gives no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_file)
        packer = Packer(tokens, segments, tokens, cut=True)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() * SEQUENCES_A_PARTITION
        out: list[tuple] = []

        def place(item: tuple, size: int, at: int) -> None:
            doc, start, total, own = item
            out.append((doc, start, size, zlib.crc32(own[: 4 * size]), total, sequence, at))

        def fill(down_to: int) -> None:
            nonlocal sequence
            while packer.n > down_to:
                parts = packer.sequence()
                length = sum(p[1] for p in parts)
                for item, size, _, back in parts:  # what is kept back goes on as an example of its own
                    if back:
                        packer.add((item[0], item[1] + size, item[2], item[3][4 * size :]), back, back)
                if length == tokens or packer.n:
                    at = 0
                    for item, size, _, _ in parts:
                        place(item, size, at)
                        at += size
                    sequence += 1
                else:
                    powers(parts, length)

        def powers(parts: list[tuple], length: int) -> None:
            nonlocal sequence
            todo = deque((item, size) for item, size, _, _ in parts)
            for bit in reversed(range(length.bit_length())):
                if not length >> bit & 1:
                    continue
                at, room = 0, 1 << bit
                while room:
                    item, size = todo.popleft()
                    used = min(size, room)
                    place(item, used, at)
                    if size > used:
                        todo.appendleft(((item[0], item[1] + used, item[2], item[3][4 * used :]), size - used))
                    at, room = at + used, room - used
                sequence += 1

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=PIECES.names)
                out.clear()

        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            names, lo = batch.column(0).to_pylist(), 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_bytes, side="right")) - 1)
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                for doc, own in zip(names[lo:hi], ids.encode(texts), strict=True):
                    own += end
                    total = len(own) // 4
                    whole = total - total % tokens
                    for start in range(0, whole, tokens):
                        out.append((doc, start, tokens, zlib.crc32(own[4 * start : 4 * (start + tokens)]), total, sequence, 0))
                        sequence += 1
                    if total > whole:
                        packer.add((doc, whole, total, own[4 * whole :]), total - whole, total - whole)
                if packer.n >= 2 * buffer:
                    fill(buffer)
                yield from told()
                lo = hi
        fill(0)
        yield from told()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
