"""Byte-level BPE by ranks, encoding and decoding, on padded numpy matrices.

Distinct pieces are bucketed by length and laid out as rows of token ids. Every round looks up the rank of every
adjacent pair in a hash table, merges each row's leftmost pair of minimum rank, closes the gap, and drops the rows
that have no pair left. Pieces of over `LONG` bytes, whose rows would be too wide, are merged with a heap, in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .arrays import blocks, flat, int_lists, lean
from .chunk_table import ChunkTable
from .common import numbered, schema_with

LONG = 512
_NONE = np.int32(2**31 - 1)
_SEED = np.uint64(0x9E3779B97F4A7C15)


class RankedBPE:
    """A vocabulary of byte strings by rank (a rank is the id); `pattern` cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.words = [b""] * size
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for word, rank in self.ranks.items() for k in range(1, len(word)) if (a := self.ranks.get(word[:k])) is not None and (b := self.ranks.get(word[k:])) is not None]
        self._build(np.array([x for x, _ in pairs], np.uint64), np.array([x for _, x in pairs], np.int32))
        self.table = ChunkTable(self._encode_all, 1 << 20)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table, filled in rounds: of the keys that want a free slot one gets it, the others go on to the next."""
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        slots = 1 << int(64 - int(self.shift))
        self.keys, self.values, self.probes = np.full(slots, 2**64 - 1, np.uint64), np.full(slots, _NONE, np.int32), 0
        slot = (keys * _SEED) >> self.shift
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == np.uint64(2**64 - 1))
            self.keys[slot[free]] = keys[free]
            set_ = self.keys[slot] == keys
            self.values[slot[set_]] = ranks[set_]
            keys, ranks, slot = keys[~set_], ranks[~set_], (slot[~set_] + np.uint64(1)) & np.uint64(slots - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merger; _NONE where there is none or a side is padding (negative)."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot = (key * _SEED) >> self.shift
        for _ in range(self.probes):
            got = self.keys[slot]
            hit = got == key
            out.ravel()[at[hit]] = self.values[slot[hit]]
            go = ~hit & (got != np.uint64(2**64 - 1))
            if not go.any():
                break
            at, key, slot = at[go], key[go], (slot[go] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian 32-bit) of each piece: its own rank if it is a word of the vocabulary, else what the merges leave."""
        out, todo, rank_of = {}, [], self.ranks.get
        for piece in pieces:
            rank = rank_of(piece)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[piece] = self._merge_long(piece)
            else:
                todo.append(piece)
        todo.sort(key=len)
        sizes = np.array([len(x) for x in todo])
        at = 0
        while at < len(todo):
            width = 1 << max(2, int(sizes[at] - 1).bit_length())
            end = min(int(np.searchsorted(sizes, width, "right")), at + (1 << 19) // width)
            out.update(zip(todo[at:end], self._merge_matrix(todo[at:end], sizes[at:end]), strict=True))
            at = end
        return out

    def _merge_matrix(self, pieces: list[bytes], sizes: np.ndarray) -> list[bytes]:
        width = int(sizes.max())
        column = np.arange(width)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[column < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        row, ends, ranks = np.arange(len(pieces)), sizes.copy(), self.pair_ranks(ids[:, :-1], ids[:, 1:])
        done, left = ids.copy(), ends.copy()
        while len(row):
            n = np.arange(len(row))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[n, at] if ranks.shape[1] else np.full(len(row), _NONE)
            go = best < _NONE
            if not go.all():
                done[row[~go], : ids.shape[1]], left[row[~go]] = ids[~go], ends[~go]
                row, ids, ranks, ends, at, best, n = row[go], ids[go], ranks[go], ends[go], at[go], best[go], n[: go.sum()]
                if not len(row):
                    break
            ends = ends - 1
            longest = int(ends.max())
            ids[n, at] = best
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), column[:longest] + (column[:longest] > at[:, None]), 1)
            if longest == 1:
                ranks = np.full((len(row), 0), _NONE, np.int32)
                continue
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=_NONE), column[: longest - 1] + (column[: longest - 1] >= at[:, None]), 1)
            some = at < longest - 1
            ranks[n[some], at[some]] = self.pair_ranks(ids[n[some], at[some]], ids[n[some], at[some] + 1])
            some = at > 0
            ranks[n[some], at[some] - 1] = self.pair_ranks(ids[n[some], at[some] - 1], ids[n[some], at[some]])
        raw, ends = done[column < left[:, None]].astype("<i4").tobytes(), (np.cumsum(left) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, place) over a linked list of parts."""
        ids, n = [int(self.single[b]) for b in piece], len(piece)
        after, before, alive, rank_of = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, self.ranks.get
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of(self.words[ids[i]] + self.words[ids[j]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], "<i4").tobytes()

    def _encode_all(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        find = self.pattern.findall
        pieces = [[p.encode() for p in x] if len(x := find(c.decode())) > 1 else [c] for c in chunks]
        known = self.encode_pieces(list({p for c in pieces for p in c}))
        parts = [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in pieces]
        return np.arange(len(chunks)), np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) for x in parts]) // 4

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        data, offsets = flat(column)
        ids, begin, whole = self.table(data, offsets, [])
        out = np.split(ids, begin[1:-1])
        for k in np.flatnonzero(whole):
            pieces = [p.encode() for p in self.pattern.findall(column[int(k)].as_py())]
            known = self.encode_pieces(list(set(pieces)))
            out[k] = np.frombuffer(b"".join([known[p] for p in pieces]), "<u4")
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids, and where each row's begin."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at], np.concatenate(([0], ends))[offsets]


@lru_cache(2)
def load(path: str, pattern: str) -> RankedBPE:
    return RankedBPE(path, pattern)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """All columns of `df` and a struct `into`: ids (array of int) and decoded (the ids' bytes, read back from them).

    Null or empty text: no ids, no bytes. A piece of any length is encoded whole; special tokens are ordinary text.
    A column that is called like `into` is replaced, all others stay, whatever their names; repeated rows stay.
    """
    df, names, text = numbered(df, into, text)
    into = "result"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, ends = flat(column)
            for i, j in blocks(ends):
                part = batch.slice(i, j - i)
                ids = int_lists(model.encode(part.column(part.schema.get_field_index(text))), np.int32)
                data, starts = model.decode(ids.values.to_numpy(), ids.offsets.to_numpy())
                decoded = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
                both = pa.StructArray.from_arrays([ids, decoded.cast(pa.binary())], ["ids", "decoded"])
                yield pa.RecordBatch.from_arrays([*part.columns, both], [*part.schema.names, into])

    return df.mapInArrow(lean(run), schema_with(df, **{into: "struct<ids: array<int>, decoded: binary>"})).toDF(*names)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of `df` and a binary `into`, the bytes of the array `ids`; null ids give no bytes."""
    df, names, ids = numbered(df, into, ids)
    into = "result"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, starts = model.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
            raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, raw.cast(pa.binary())], [*batch.schema.names, into])

    return df.mapInArrow(lean(run), schema_with(df, **{into: "binary"})).toDF(*names)
