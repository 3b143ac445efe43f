"""Token ids in compressed files: one wavelet matrix for each shard.

A shard holds the ids of a run of documents in ascending order of doc_id. Its ids are stored as bit-planes: the first
has the ids' highest bits; below it, the ids are dealt stably into those with a 0 and those with a 1, and so on. With
counts of ones before every block of a plane this gives, from the one file: the id at any place, how often an id occurs
before a place, and the place of its k-th occurrence. Planes are compressed in blocks of their own, so that a query
unpacks a few blocks only.

File: magic "WVMX1", header length (u4), header (JSON: n, bits, zeros, docs, block lengths), compressed doc ids and ends,
compressed plane blocks, plane by plane.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import blocks, flat, lean
from .chunk_table import ChunkTable
from .common import renamed

MAGIC = b"WVMX1"
#: Bytes of a plane in one compressed block, and the ids after which a shard is closed.
BLOCK = 1 << 15
SHARD_IDS = 1 << 21


def build(ids: np.ndarray, docs: list[int | None], ends: np.ndarray) -> bytes:
    """The file of one shard: `docs` in order, `ends` where each one's ids end."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack, zeros, parts, sizes = zstandard.ZstdCompressor(level=1).compress, [], [], []
    for k in range(bits - 1, -1, -1):
        one = (x >> k & 1).astype(bool)
        plane = np.packbits(one, bitorder="little")
        for i in range(0, len(plane), BLOCK):
            block = plane[i : i + BLOCK]
            parts.append(struct.pack("<I", int(np.bitwise_count(block).sum())) + pack(block.tobytes()))
            sizes.append(len(parts[-1]))
        low = x[~one]
        zeros.append(len(low))
        x = np.concatenate((low, x[one]))
    index = pack(np.array([-(2**63) if d is None else d for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], bool).tobytes() + ends.astype("<i8").tobytes())
    header = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "docs": len(docs), "index": len(index), "sizes": sizes}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + index + b"".join(parts)


class Shard:
    """Answers from the bytes of one file."""

    def __init__(self, raw: bytes):
        if raw[:5] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", raw, 5)
        head = json.loads(raw[9 : 9 + size])
        self.n, self.bits, self.zeros, at = head["n"], head["bits"], head["zeros"], 9 + size
        unpack = zstandard.ZstdDecompressor().decompress
        index, k = unpack(raw[at : at + head["index"]]), head["docs"]
        null = np.frombuffer(index, bool, k, 8 * k)
        self.docs = [None if e else d for d, e in zip(np.frombuffer(index, "<i8", k).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(index, "<i8", k, 9 * k)
        edges = at + head["index"] + np.concatenate(([0], np.cumsum(head["sizes"], dtype=np.int64)))
        per = len(head["sizes"]) // self.bits
        ones = [struct.unpack_from("<I", raw, e)[0] for e in edges[:-1]]
        self.before = [np.concatenate(([0], np.cumsum(ones[k * per : (k + 1) * per], dtype=np.int64))) for k in range(self.bits)]
        self._block = lru_cache(64)(lambda k, b: np.frombuffer(unpack(raw[edges[k * per + b] + 4 : edges[k * per + b + 1]]), np.uint8))
        self._per = per

    def _bit(self, k: int, i: int) -> int:
        return int(self._block(k, i // (8 * BLOCK))[i % (8 * BLOCK) // 8]) >> i % 8 & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, r = divmod(i, 8 * BLOCK)
        if not r:
            return int(self.before[k][b])
        block = self._block(k, b)
        return int(self.before[k][b]) + int(np.bitwise_count(block[: r // 8]).sum()) + (int(block[r // 8] & (1 << r % 8) - 1).bit_count() if r % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, token: int, i: int) -> int:
        """How often `token` occurs among the first i ids."""
        a, b = self._range(token, i)
        return b - a

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of `token`, from 0; -1 if there are fewer."""
        a, b = self._range(token, self.n)
        if k >= b - a:
            return -1
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            want, lo, hi = (i - self.zeros[level] if bit else i), 0, self.n
            while lo < hi:  # the last place with `want` such bits before it
                mid = (lo + hi) // 2
                have = self._ones(level, mid + 1)
                lo, hi = (mid + 1, hi) if (have if bit else mid + 1 - have) <= want else (lo, mid)
            i = lo
        return i

    def places(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the deals are undone from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._block(k, b) for b in range(self._per)]) if self._per else np.zeros(0, np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(x)
            up[~one] = x[: self.zeros[k]]
            up[one] = x[self.zeros[k] :] | x.dtype.type(1 << (self.bits - 1 - k))
            x = up
        return x


class _Library:
    """The tokenizers library behind a table of chunks; a text in which a chunk could be ambiguous goes to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        size = self.model.get_vocab_size()
        self.blank = np.array([(self.model.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # byte-level form of a blank
        self.table = ChunkTable(self._joined)

    def _joined(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that begin with a blank are encoded as one long text: each of them starts with the one id that has a blank in front."""
        ids, sizes = [], []
        plain = [k for k, c in enumerate(chunks) if c[:1] != b" " or len(c) == 1]
        alone = set(plain)
        rest = [k for k in range(len(chunks)) if k not in alone]
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            ids.append(np.array(self.model.encode_batch_fast([b"".join([chunks[k] for k in some]).decode()], add_special_tokens=False)[0].ids, np.uint32))
            first = np.flatnonzero(self.blank[ids[-1]])
            if len(first) != len(some):
                raise ValueError("a chunk has not exactly one id that starts with a blank")
            sizes.append(np.diff(first, append=len(ids[-1])))
        for e in self.model.encode_batch_fast([chunks[k].decode() for k in plain], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        return np.array(rest + plain), np.concatenate(ids), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = flat(column)
        ids, begin, whole = self.table(data, offsets, self.added)
        out = np.split(ids, begin[1:-1])
        for k in np.flatnonzero(whole):
            out[k] = np.array(self.model.encode(column[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(2)
def _library(path: str) -> _Library:
    return _Library(path)


def write_tokens(df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with `end_id` behind it, and returns one row for each file: part, seq, file,
    n_docs, n_ids, start (ids in all files before it).

    Documents are dealt by ranges of doc_id and sorted within; rows of one doc_id stand together, those of a null doc_id
    first. A null text is empty and has the end id only. `folder` is one that driver and executors share. A file is
    written under a name of its own and then moved, so a task that is run again leaves whole files. Other columns are not read.
    """
    own = renamed(df, doc_id=doc_id, text=text)
    parts = own.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = own.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, docs, held = TaskContext.get().partitionId(), 0, [], []
        tail, model, place = np.array([end_id], "<u4"), _library(path), fs.FileSystem.from_uri(folder)

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            name = f"{part:06d}-{seq:06d}.wvm"
            store, top = place
            store.create_dir(top, recursive=True)
            with store.open_output_stream(tmp := f"{top}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(build(np.concatenate(held), docs, ends))
            store.move(tmp, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [len(docs)], "n_ids": [int(ends[-1])]})

        size = 0
        for batch in batches:
            _, ends = flat(batch.column(1))
            for i, j in blocks(ends):
                for d, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), model.encode(batch.column(1).slice(i, j - i)), strict=True):
                    ids = np.concatenate((ids, tail))
                    docs.append(d)
                    held.append(ids)
                    size += len(ids)
                    if size >= SHARD_IDS:
                        yield close()
                        seq, docs, held, size = seq + 1, [], [], 0
        if docs:
            yield close()

    files = spread.mapInArrow(lean(run), "part int, seq int, file string, n_docs long, n_ids long")
    files = files.checkpoint()
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect()  # as many rows as partitions
    starts, at = [], 0
    for row in parts:
        starts.append((row["part"], at))
        at += row["ids"]
    before = files.sparkSession.createDataFrame(starts, "part int, before long")
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return files.join(before, "part").select("part", "seq", "file", "n_docs", "n_ids", (F.col("before") + within).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """One row for each document of the files that write_tokens names: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path) as f:
                    shard = Shard(f.read())
                raw, ends = shard.ids().astype("<u4").tobytes(), shard.ends
                begins = np.concatenate(([0], ends[:-1]))
                for i in range(0, len(ends), 2000):
                    a, b = begins[i : i + 2000], ends[i : i + 2000]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.docs[i : i + 2000], pa.int64()), "start": pa.array(a + start), "n_tokens": pa.array(b - a), "ids": pa.array([raw[4 * x : 4 * y] for x, y in zip(a, b, strict=True)], pa.binary())})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(n, "file").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")
