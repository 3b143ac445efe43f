"""Substring deduplication: every passage of `width` words that occurs more than once is taken out, wherever it stands.

1. Texts are dealt into chunks of a few MB by a hash of the row.
2. Each chunk finds the Rabin-Karp hash of every window of `width` words and sends each distinct one once, packed by
   ranges of the hash (a combine before the shuffle: a passage that a third of all texts share leaves a chunk once).
3. Each range of hashes, of bounded size, reports to every chunk which of its hashes other chunks have as well.
4. Each chunk joins those with the windows it holds twice itself; covered words are merged into maximal intervals.

Only 8 bytes a window are shuffled, and the texts once: both uses of the chunks read the same exchange. The range is taken
from a second, independent hash, so windows are told apart by 64 bits and those of the range, whose number grows with the
input: of n distinct windows about n*n / 2**(65 + bits) pairs are mistaken for each other, about 1 among the 10**13
windows of 100 TB (24 bits), where a chunk's own windows, told apart by 64 bits, count as well. Each word's own hash has 64 bits, of words over 64 bytes by another function.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, fingerprints, flat, mix, windows, words
from .common import fresh, numbered, renamed, row_hash, schema_with, total_bytes

CHUNK_BYTES = 4 << 20
BUCKET_WINDOWS = 1 << 20
_OTHER = np.uint64(0x6A09E667F3BCC909)


def _hashed(data: np.ndarray, offsets: np.ndarray, width: int, bits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: index of each one's first word, starts of the windows (in words), their hashes, and with `bits` their ranges."""
    firsts, starts, hashes, ranges, n = [np.zeros(1, np.int64)], [], [], [], 0
    for i, j in blocks(offsets):
        own, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        a, b, first = words(own, cut)
        prints = fingerprints(own, a, b)
        at, h = windows(prints, first, width)
        if bits:
            ranges.append((windows(mix(prints ^ _OTHER), first, width)[1] >> np.uint64(64 - bits)).astype(np.int32))
        starts.append(at + n)
        hashes.append(h)
        firsts.append(first[1:] + n)
        n += len(a)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return np.concatenate(firsts), join(starts, np.int64), join(hashes, np.uint64), join(ranges, np.int32)


def remove_repeated_passages(df: DataFrame, text: str = "text", width: int = 35, into: str = "passages") -> DataFrame:
    """All columns of `df` and a struct `into`: n_words, n_removed, kept (words left, joined by one space) and spans
    (maximal intervals [start, end) of removed words).

    A window is `width` consecutive words `[^\\x20\\x09-\\x0D]+` of one row; it is repeated if the same words start
    anywhere else, in the same row or another (a repeated row repeats all of its windows). Windows are judged on the input.
    Null or empty text: no words, kept is empty. Fewer words than `width`: nothing is removed. An empty table gives an
    empty table. A column that is called like `into` is replaced; other columns are left alone, whatever their names.
    """
    df, names, text = numbered(df, into, text)
    into = "result"
    chunk, size = fresh(df, "chunk"), total_bytes(renamed(df, t=text), "t")
    chunks = max(1, -(-size // CHUNK_BYTES))
    bits = max(1, (size // 6 // BUCKET_WINDOWS).bit_length())
    dealt = df.withColumn(chunk, F.pmod(F.xxhash64(row_hash(df), F.spark_partition_id()), F.lit(chunks)))  # equal rows of a large table don't meet in one chunk

    def send(t: pa.Table) -> pa.Table:
        _, _, h, place = _hashed(*flat(t[text]), width, bits)
        h, first = np.unique(h, return_index=True)
        order = np.argsort(place[first], kind="stable")
        h = h[order]
        edge = np.searchsorted(place[first][order], np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(edge))
        return pa.table({"chunk": np.full(len(full), t[chunk][0].as_py()), "bucket": full.astype(np.int32), "hashes": pa.array([h[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        h = np.concatenate(lists)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cut = np.cumsum([len(x) for x in lists])[:-1]
        found = [x[m] for x, m in zip(lists, np.split(twice, cut), strict=True)]
        has = [len(x) > 0 for x in found]
        return pa.table({"chunk": pa.array(list(compress(t["chunk"].to_pylist(), has)), pa.int64()), "hashes": pa.array([x.tobytes() for x in compress(found, has)], pa.binary())})

    def take_out(t: pa.Table, elsewhere: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], t[c].type) for c in t.column_names if c != chunk} | {into: pa.array([], kind)})
        data, offsets = flat(t[text])
        first, at, h, _ = _hashed(data, offsets, width)
        own, times = np.unique(h, return_counts=True)
        known = np.unique(np.concatenate([own[times > 1], *(np.frombuffer(x, np.uint64) for x in elsewhere["hashes"].to_pylist())]))
        edge = np.zeros(first[-1] + 1, np.int32)
        if len(known):
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, rows = data.tobytes(), []
        for k in range(t.num_rows):
            out, split = gone[first[k] : first[k + 1]], raw[offsets[k] : offsets[k + 1]].split()
            step = np.flatnonzero(np.diff(out, prepend=False, append=False))
            rows.append({"n_words": len(split), "n_removed": int(out.sum()), "kept": b" ".join(compress(split, ~out) if len(step) else split).decode(), "spans": [{"start": int(a), "end": int(b)} for a, b in zip(step[::2], step[1::2], strict=True)]})
        return pa.table({c: t[c] for c in t.column_names if c != chunk} | {into: pa.array(rows, kind)})

    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.field("element", pa.struct([("start", pa.int64()), ("end", pa.int64())]))))])
    sent = dealt.groupBy(chunk).applyInArrow(send, "chunk long, bucket int, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(meet, "chunk long, hashes binary")
    schema = schema_with(df, **{into: "struct<n_words: long, n_removed: long, kept: string, spans: array<struct<start: long, end: long>>>"})
    return dealt.groupBy(chunk).cogroup(told.groupBy("chunk")).applyInArrow(take_out, schema).toDF(*names)
