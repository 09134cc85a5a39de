"""Word scanning of Arrow text columns with NumPy.

A batch of texts is one byte buffer with offsets. Word bounds come from a table of word bytes. The hash of a run of words
is a difference of running sums of a polynomial modulo 2**64 over the hashes of the words, so that any run costs the
same. Texts are bytes throughout: nothing is decoded, and nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

U64 = np.uint64
ALL = U64((1 << 64) - 1)
RUN_BASE, RUN_BASE_2 = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
SLICE_BYTES = 2 << 20
#: Words whose running sums are made together, and bytes from which on a word is hashed by itself.
PART, LONG_WORD = 1 << 18, 256

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(pattern: str) -> np.ndarray:
    """Which bytes are word bytes: 'space' for all but white space, 'alnum' for 0-9, a-z, A-Z and non-ASCII."""
    inside = np.zeros(256, dtype=bool)
    if pattern == "space":
        inside[:] = True
        inside[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = True
        inside[0x80:] = True
    else:
        raise ValueError(pattern)
    return inside


SPACE, ALNUM = table("space"), table("alnum")


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n at least, modulo 2**64. Tables are kept, and grow with the longest run of words asked for."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        up, down = np.full(size, U64(base)), np.full(size, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        _TABLES[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _TABLES[base]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift, three times)."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """Some consecutive texts: bytes, offsets, and the words found in them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool):
        self.raw, self.offsets = raw, offsets
        self.buf = LOWER[raw] if lower else raw
        n = len(raw)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        flags = inside[raw]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        left, right = np.empty(n, bool), np.empty(n, bool)
        left[0] = right[-1] = False
        left[1:], right[:-1] = flags[:-1], flags[1:]
        left[cuts] = False
        right[cuts - 1] = False
        self.starts = np.flatnonzero(flags & ~left)
        self.ends = np.flatnonzero(flags & ~right) + 1
        #: words first[d] to first[d+1] are those of text d
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.n_words)

    def room(self) -> np.ndarray:
        """How many words of its text there are from each word on, itself included."""
        return np.repeat(self.first[1:], self.n_words) - np.arange(len(self.starts))

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes a step, each step a bijection of what came before: words of up to eight bytes have different ones.

        Words beyond LONG_WORD bytes take XXH64. Hashes of two salts are independent.
        """
        size = self.ends - self.starts
        out = mix(size.astype(U64), 0x5BF03635 + salt)
        at = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(at) - 7,), "<u8", at, strides=(1,))  # the eight bytes from each place on
        live = np.flatnonzero(size <= LONG_WORD)
        done = 0
        while len(live):
            left = size[live] - done
            part = eight[self.starts[live] + done]
            part &= ALL >> (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64)))
            out[live] = mix(out[live] ^ part, salt + 1)
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = mix(np.array([xxh64_intdigest(self.word(i), salt)], U64))[0]
        return out

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def runs(hashes: np.ndarray, k: int, base: int = RUN_BASE, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 places are left out. Runs may cross texts: see room()."""
    out = np.zeros(max(0, len(hashes) - k + 1), U64)
    for lo in range(0, len(out), PART):
        own = hashes[lo : min(lo + PART, len(out)) + k - 1]
        n = len(own)
        up, down = powers(base, n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((mix(own, salt) if salt else own) * up[:n], out=total[1:])
        out[lo : lo + n - k + 1] = mix((total[k:] - total[:-k]) * down[: n - k + 1], k)
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, inside: np.ndarray, lower: bool, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Rows from, rows to, and their Texts: at least one row and at most about `most` bytes at a time."""
    raw, offsets = column_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, Texts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], inside, lower)
        lo = hi
    release()


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one per word) over the words of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in runs of `length` words from `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
