"""Token counts by prefix dynamic programming over a SentencePiece BPE vocabulary.

In a BPE encoding, tokens a, b may stand side by side exactly if a+b alone is encoded as a, b. So the last token of the encoding
of each prefix follows from those of shorter prefixes: it is the one piece that ends there and may follow the last token
of what precedes it. The count at each prefix is one more than the count there. All prefixes of a text thus have exact
counts after one pass, and budgets or truncation need no further encoding. No piece of the vocabulary has a space
after another character, nor a line feed, so words stand alone and are worked out once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memo import Memo
from .words import column_bytes

MARK = "▁"
WORD = re.compile(r" *[^ \n]+| +|\n")


class PrefixCounts:
    """Exact token counts of every prefix of a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("pieces of this vocabulary reach beyond a word")
        self.longest = max(map(len, self.score))
        self.may: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        #: by word; one that begins with neither a line feed nor a space stands for itself after a space, one that begins with a space is as it is without the first
        self.totals = Memo(lambda words: [self.prefixes(w[1:] if w[:1] == " " else w if w[:1] == "\n" else " " + w)[-1] for w in words])

    def merged(self, text: str) -> list[str]:
        """BPE proper of a short text: the best pair first, from the left among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjoin(self, a: str, b: str) -> bool:
        ok = self.may.get((a, b))
        if ok is None:
            if len(self.may) > 1_000_000:
                self.may.clear()
            ok = self.may[a, b] = self.merged(a + b) == [a, b]
        return ok

    def begins(self, a: str) -> bool:
        ok = self.whole.get(a)
        if ok is None:
            ok = self.whole[a] = self.merged(a) == [a]
        return ok

    def prefixes(self, word: str) -> list[int]:
        """Counts of word[:0], word[:1], ... up to the whole word."""
        w, score, longest = word.replace(" ", MARK), self.score, self.longest
        last: list[str | None] = [""]
        counts = [0]
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - longest), i):
                piece = w[j:i]
                if piece in score:
                    before = last[j]
                    # nothing merges with a character that is no piece (last: None), so what follows it starts anew
                    if self.begins(piece) if not before else self.adjoin(before, piece):
                        last.append(piece)
                        counts.append(counts[j] + 1)
                        break
            else:
                last.append(None)
                counts.append(counts[i - 1] + len(w[i - 1].encode()))
        return counts

    def counts(self, texts: Sequence[str]) -> list[int]:
        """Counts of whole texts: sums over words, which begin at a space or a line feed."""
        found = []
        for t in texts:
            if "  " in t or t[:1] == " " or MARK in t:  # spaces that meet may be one piece
                found.append([" " + w for w in WORD.findall(" " + t.replace(MARK, " "))])
            else:
                found.append(t.replace("\n", " \n").split(" ") if t else [])
        return list(map(sum, self.totals.resolve(found)))

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def every_prefix(self, text: str) -> np.ndarray:
        """Counts of text[:0], text[:1], ..., text. The mark that the encoder puts before a text counts from the first character on."""
        out, total = [0], 0
        for k, w in enumerate(WORD.findall(" " + text.replace(MARK, " ")) if text else []):
            own = self.prefixes(w)
            out += [total + c for c in own[2 if k == 0 else 1 :]]
            total += own[-1]
        return np.array(out, np.int64)

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most `budget` tokens."""
        return int(np.flatnonzero(self.every_prefix(text) <= budget)[-1]) if budget >= 0 else 0


@lru_cache(maxsize=2)
def prefix_counts(model_file: str) -> PrefixCounts:
    """One for all tasks of a Python worker, so that words stay known."""
    return PrefixCounts(model_file)


def token_counts(docs: DataFrame, model_file: str, budgets: Sequence[int] = (), prefixes: bool = False, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id, n_tokens, for each budget cut_<budget> (characters that fit), and with `prefixes` the counts at every prefix.

    Null and empty texts have no tokens. Rows stay in their partitions: nothing is shuffled, and a text of any length is worked on whole.
    Repeated rows give repeated results; other columns play no part.
    """
    fields = [T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(f"cut_{b}", T.LongType()) for b in budgets] + [T.StructField("prefix_tokens", T.ArrayType(T.LongType()))] * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(model_file)
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            totals, lo, n = [], 0, batch.num_rows
            cuts: list[list[int]] = [[] for _ in budgets]
            every = []
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_bytes, side="right")) - 1)
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                totals += counter.counts(texts)
                for out, b in zip(cuts, budgets, strict=True):
                    out += [counter.cut(t, b) for t in texts]
                if prefixes:
                    every += [counter.every_prefix(t).tolist() for t in texts]
                lo = hi
            columns = [batch.column(0), pa.array(totals, pa.int64()), *(pa.array(c, pa.int64()) for c in cuts), *([pa.array(every, pa.list_(pa.int64()))] if prefixes else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_column, text_column).mapInArrow(run, T.StructType(fields))


def report(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is above the limit."""
    with_bytes = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("key"), "text")
    counted = token_counts(with_bytes, model_file, id_column="key")
    return counted.select("key.doc_id", "key.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
