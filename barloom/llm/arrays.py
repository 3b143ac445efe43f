"""Vectorised words and Rabin-Karp fingerprints over Arrow string buffers.

A column of texts is one byte buffer with offsets; words, fingerprints and windows are found for all of its texts
at once. Prefix sums modulo 2**64 with an odd base (which has an inverse) give the hash of any run of bytes or
words by one subtraction and one multiplication.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in blocks of about so many bytes, which bounds the temporary arrays.
BLOCK = 1 << 20
#: Bytes of a word up to which the polynomial tells words apart; modulo 2**64 it fails for some very long ones (Thue-Morse words).
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of words `[^\x20\x09-\x0D]+`.
WHITE = table_of((0x20, 0x20), (0x09, 0x0D))
#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1, and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry than texts). A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes in all; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and the index of each text's first word."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators[data], out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes: a polynomial, or of words over `LONG_WORD` bytes a hash of their own."""
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:-1], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse[starts])
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def windows(prints: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs of `width` words that lie in one text."""
    n = len(prints)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(prints * p[:-1], out=sums[1:])
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - width + 1) + width <= end[: n - width + 1])
    return at, mix((sums[at + width] - sums[at]) * inverse[at])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, after which a worker gives back the memory that its freed arrays leave behind."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def int_lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    """A list array of one part for each row."""
    sizes = np.array([len(x) for x in parts], np.int64)
    flat_ = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat_))


def ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of each word, of its length and its first and last eight bytes: all of a word of up to 16 bytes."""
    size, out = ends - starts, mix((ends - starts).astype(np.uint64))
    for at, seed in ((starts[:, None] + np.arange(8), 3), (ends[:, None] - 1 - np.arange(8), 5)):
        inside = (at >= starts[:, None]) & (at < ends[:, None])
        eight = np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)
        out = mix(out * np.uint64(0xD1342543DE82EF95) + np.uint64(seed) + np.ascontiguousarray(eight).view(np.uint64).ravel())
    return np.where(size > 0, out, np.uint64(0))


class Memo:
    """Values of words by two hashes, 128 bits, in a table of fixed size: of words that want the same slot the last one stays."""

    def __init__(self, kind: type, slots: int = 1 << 20):
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys, self.seconds, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, kind)

    def __call__(self, prints: np.ndarray, seconds: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each word; `compute` gives those of the words at the given places."""
        slot = prints >> self.shift
        known = (self.keys[slot] == prints) & (self.seconds[slot] == seconds) & (prints != 0)
        out = self.values[slot]
        new = np.flatnonzero(~known)
        if len(new):
            order = np.lexsort((seconds[new], prints[new]))
            a, b = prints[new][order], seconds[new][order]
            first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            one = new[order[first]]
            value = np.asarray(compute(one), self.values.dtype)
            out[new[order]] = value[np.cumsum(first) - 1]
            place = slot[one]
            self.keys[place], self.seconds[place], self.values[place] = prints[one], seconds[one], value
        return out
