"""Ids of texts through a table of chunks, kept in numpy arrays: lookups and copies are done for a block of texts at once.

A chunk is a blank and what follows it up to the next blank or line feed; a line feed is a chunk of its own. In a text
without two white-space characters in a row a byte-level BPE tokenizer of the usual pattern cuts at all of these places,
so chunks have the same ids everywhere. Other texts, and those with an added token, are given to the tokenizer whole.
Chunks are found by 64-bit fingerprints, and the bytes of a chunk that is found are compared with those that the table
keeps; a text with a chunk that differs from the one of the same fingerprint is given to the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .arrays import fingerprints

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# UTF-8 forms of the white-space characters beyond ASCII, as (lead byte, second byte).
_WIDE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


class ChunkTable:
    """`encode_all` gives, for a list of chunks, an order of its own, all ids in that order, and how many each chunk has."""

    def __init__(self, encode_all: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], slots: int = 1 << 21):
        self.encode_all, self.slots = encode_all, slots
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows, self.n = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0
        self.starts, self.sizes = np.zeros(self.slots // 2 + 1, np.int64), np.zeros(self.slots // 2, np.int32)
        self.ids, self.bytes, self.begins = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8), np.zeros(self.slots // 2 + 1, np.int64)

    def _find(self, prints: np.ndarray) -> np.ndarray:
        """The row of each fingerprint; -1 where there is none."""
        out = np.full(len(prints), -1, np.int32)
        at, slot = np.arange(len(prints)), prints >> self.shift
        while len(at):
            key = self.keys[slot]
            hit = key == prints[at]
            out[at[hit]] = self.rows[slot[hit]]
            go = ~hit & (key != 0)
            at, slot = at[go], (slot[go] + np.uint64(1)) & np.uint64(self.slots - 1)
        return out

    def _add(self, prints: np.ndarray, ids: np.ndarray, sizes: np.ndarray, chunks: list[bytes]) -> None:
        rows, raw = np.arange(self.n, self.n + len(prints), dtype=np.int32), np.frombuffer(b"".join(chunks), np.uint8)
        for name, new, edges, lengths in (("ids", ids, self.starts, sizes), ("bytes", raw, self.begins, np.array([len(c) for c in chunks]))):
            kept, begin = getattr(self, name), edges[self.n]
            if begin + len(new) > len(kept):
                kept = np.concatenate((kept[:begin], np.zeros(max(len(new), len(kept)), kept.dtype)))
                setattr(self, name, kept)
            kept[begin : begin + len(new)] = new
            edges[self.n + 1 : self.n + 1 + len(prints)] = begin + np.cumsum(lengths)
        self.sizes[rows] = sizes
        self.n += len(prints)
        slot = prints >> self.shift
        while len(rows):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = prints[free]
            mine = self.keys[slot] == prints
            self.rows[slot[mine]] = rows[mine]
            rows, prints, slot = rows[~mine], prints[~mine], (slot[~mine] + np.uint64(1)) & np.uint64(self.slots - 1)

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, kept: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the chunks whose bytes aren't those at `begin` in `kept`, `sizes` of them."""
        size = ends - starts
        out = size != sizes
        at = np.flatnonzero(~out & (size > 0))
        if len(at):
            edge = np.cumsum(size[at]) - size[at]
            shift = np.arange(edge[-1] + size[at[-1]]) - np.repeat(edge, size[at])
            same = data[np.repeat(starts[at], size[at]) + shift] == kept[np.repeat(begin[at], size[at]) + shift]
            out[at] = ~np.logical_and.reduceat(same, edge)
        return np.flatnonzero(out)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each one's begin, and which texts must be encoded whole (those have no ids here)."""
        texts, n = len(offsets) - 1, len(data)
        whole = np.zeros(texts, bool)
        space = _SPACE[data]
        pairs = np.flatnonzero(space[1:] & space[:-1]) + 1
        text_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        pairs = pairs[offsets[text_of(pairs)] < pairs]
        whole[text_of(pairs)] = True
        lead = np.flatnonzero(data[:-1] >= 0xC2) if n else pairs
        lead = lead[(data[lead] == 0xC2) | (data[lead] >= 0xE1) & (data[lead] <= 0xE3)]
        for a, b in _WIDE:
            whole[text_of(lead[(data[lead] == a) & (data[lead + 1] == b)])] = True
        raw = data.tobytes()
        for token in added:
            at = raw.find(token)
            while at >= 0:
                whole[text_of(at)] = True
                at = raw.find(token, at + 1)
        cut = np.zeros(n + 1, bool)
        feed = np.flatnonzero(data == 10)
        cut[:n] |= data == 32
        cut[feed] = cut[feed + 1] = cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        use = ~whole[text_of(starts)]
        starts, ends = starts[use], ends[use]
        prints = fingerprints(data, starts, ends)
        prints[prints == 0] = 1
        rows = self._find(prints)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            distinct, first = np.unique(prints[miss], return_index=True)
            if self.n + len(distinct) > self.slots // 2:
                self._clear()
                distinct, first = np.unique(prints, return_index=True)
                miss = np.arange(len(prints))
            at = miss[first]
            chunks = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            order, ids, sizes = self.encode_all(chunks)
            if len(distinct) > self.slots // 2:  # a block with more chunks than the table holds
                one = np.searchsorted(distinct, prints)
                row, lengths = np.argsort(order)[one], (ends - starts)[at]
                bad = self._unlike(data, starts, ends, starts[at][one], data, lengths[one])
                whole[text_of(starts[bad])] = True
                return self._spread(ids, (np.cumsum(sizes) - sizes)[row], sizes[row], starts, offsets, whole)
            self._add(distinct[order], ids, sizes, [chunks[k] for k in order.tolist()])
            rows[miss] = self._find(prints[miss])
        bad = self._unlike(data, starts, ends, self.begins[rows], self.bytes, self.begins[rows + 1] - self.begins[rows])
        whole[text_of(starts[bad])] = True
        return self._spread(self.ids, self.starts[rows], self.sizes[rows], starts, offsets, whole)

    @staticmethod
    def _spread(ids, begin, sizes, starts, offsets, whole):
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return ids[at], np.concatenate(([0], ends))[np.searchsorted(starts, offsets)], whole
