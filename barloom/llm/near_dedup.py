"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Each text's set of word shingles is hashed once. A hash's range is its bin, the least hash of a bin its value; an
   empty bin borrows the value of a full one that its own random probes find first (Shrivastava, 2017). 42 bands of 3
   bins: a pair of similarity 0.75 shares no band with probability (1 - 0.75**3)**42 = 1e-10.
2. Documents with the same set form a class; only its smallest id, the representative, goes on. A class of any size
   is one row of an aggregate.
3. A bucket (documents with the same band) is star-shaped: every member is paired with the smallest id only, so pairs
   grow with the rows and never with the square of a bucket.
4. Pairs are confirmed on full sets: a table of the sets of bucketed documents is joined to both sides.
5. Confirmed links make components. A star can miss a link between two members that aren't like its centre; so the
   candidate stars, confirmed or not, are joined into families (two documents that share a band are in one family). In
   a family of several components a shingle is foreign to a document if another component has it too. A link between
   components needs `percent` of a document's shingles to be foreign, so documents with fewer drop out, which is exact,
   and shrinks the others' foreign shingles in turn. Those that are left are held against each other on full sets, in
   blocks of bounded size; a block returns a spanning forest of its links, so rows stay in proportion to documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, blocks, fingerprints, flat, int_lists, lean, mix, powers, windows, words
from .common import cut_lineage, fresh, renamed
from .graph import components

BANDS, ROWS = 42, 3
BINS = BANDS * ROWS
#: Shingles on either side of a block, and in one chunk of documents or range of hashes.
BLOCK_SHINGLES = 1 << 20
#: Families (an id each) that are broadcast; more of them are joined by a shuffle.
BROADCAST_FAMILIES = 1_000_000
_SALT = np.uint64(0xA24BAED4963EE407)


@lru_cache(1)
def _probes(n: int = 4096) -> np.ndarray:
    x = np.arange(BINS * n, dtype=np.uint64).reshape(BINS, n)
    return ((mix(x * _SALT + np.uint64(1)) >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int16)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words, lower-cased A-Z; with fewer words, of the whole sequence."""
    data, offsets = flat(column)
    out: list[np.ndarray] = []
    for i, j in blocks(offsets):
        own = LOWER[data[offsets[i] : offsets[j]]]
        a, b, first = words(own, offsets[i : j + 1] - offsets[i])
        prints = fingerprints(own, a, b)
        at, h = windows(prints, first, width)
        cut = np.searchsorted(at, first)
        p, inverse = powers(width)
        for k in range(j - i):
            n = first[k + 1] - first[k]
            if n >= width:
                out.append(np.unique(h[cut[k] : cut[k + 1]]))
            elif n:
                out.append(mix((prints[first[k] : first[k + 1]] * p[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _SALT))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The band hashes of a sorted set; none for an empty set."""
    if not len(hashes):
        return hashes
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    firsts = np.flatnonzero(np.diff(bins, prepend=-1))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[firsts]], full[bins[firsts]] = hashes[firsts], True
    empty = np.flatnonzero(~full)
    width = 32
    while len(empty):
        probes = _probes(max(4096, width))[empty, :width]
        found = full[probes]
        ok = found.any(1)
        values[empty[ok]] = values[probes[ok, found[ok].argmax(1)]]
        empty, width = empty[~ok], width * 8
    lanes = mix(values.reshape(BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * _SALT)
    return mix(lanes.sum(1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64) * _SALT)


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums of each set's hashes, which tell sets apart."""
    return np.array([[mix(s).sum(dtype=np.uint64), mix(s * _SALT + np.uint64(7)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, j - i) for whole in batches for i, j in blocks(flat(whole.column(1))[1], 1 << 22)):
            sets = shingle_sets(batch.column(1), width)
            two = _prints(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), int_lists([signature(s) for s in sets], np.int64)], ["id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(lean(run), "id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, print, hashes) of docs (id, text): print is the f1 of the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = flat(batch.column(1))
            for i, j in blocks(ends, 1 << 22):
                sets = shingle_sets(batch.column(1).slice(i, j - i), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(_prints(sets)[:, 0]), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "print", "hashes"])

    return docs.mapInArrow(lean(run), "id long, print long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, pa, b, pb: ids and prints) those whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("print").alias("pa"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("print").alias("pb"), F.col("hashes").alias("y"))
    return pairs.select("a", "pa", "b", "pb").join(two, ["b", "pb"]).join(one, ["a", "pa"]).select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """For each row of `df`: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included),
    kept (doc_id = component_id).

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles|. Words are `[^\\x20\\x09-\\x0D]+`
    with A-Z lower-cased; fewer words than `width` are one shingle. Null or empty text: no shingles, linked with nothing.
    A null doc_id: n_shingles is counted, component_id is null and the row is kept, linked with nothing. Rows that
    share a doc_id share the component that any of them reaches. Other columns of `df`, whatever their names, are not read.
    """
    docs = renamed(df, id=doc_id, text=text)
    signed = cut_lineage(_signatures(docs, width))
    real = signed.where("n > 0 and id is not null")
    classes = cut_lineage(real.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min("n").alias("n")))
    banded = classes.select("rep", "f1", "n", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min(F.struct("rep", "n", "f1")).alias("least"), F.count("*").alias("members")).where("members > 1")
    starred = banded.join(full, "band").where(F.col("rep") != F.col("least.rep"))
    stars = cut_lineage(starred.select(F.col("least.rep").alias("a"), F.col("least.f1").alias("pa"), F.col("rep").alias("b"), F.col("f1").alias("pb"), F.col("least.n").alias("x"), F.col("n").alias("y")).distinct())
    families = cut_lineage(components(stars))
    bucketed = docs.join(families.select(F.col("node").alias("id")), "id", "left_semi").groupBy("id", F.xxhash64("text").alias("own")).agg(F.max("text").alias("text"))
    sets = cut_lineage(_sets(bucketed.select("id", "text"), width))
    pairs = stars.where(100 * F.least("x", "y") >= percent * F.greatest("x", "y"))
    links = cut_lineage(_same_id(real, classes).unionByName(_confirmed(pairs, sets, percent)))
    found = cut_lineage(components(links))
    more = cut_lineage(_across(classes, families, found, sets, percent))
    if not more.isEmpty():
        found = cut_lineage(components(links.unionByName(more)))
    by_class = classes.join(found, classes["rep"] == found["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("id", "n", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _same_id(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between an id that rows of unlike texts share and the representatives of their classes."""
    several = real.groupBy("id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("id")
    rows = real.join(several, "id", "left_semi").select("id", "f1", "f2").distinct()
    return rows.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))


def _across(classes: DataFrame, families: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of one family, enough of them to join all components that links join."""
    placed = classes.select("rep", F.col("f1").alias("print"), "n").join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    placed = placed.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = cut_lineage(placed.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family"))
    some = F.broadcast(split) if split.count() <= BROADCAST_FAMILIES else split
    rows = placed.join(some, "family", "left_semi").join(sets.withColumnRenamed("id", "rep"), ["rep", "print"])
    rows = cut_lineage(rows.select("family", "rep", "component", "n", "hashes"))
    for _ in range(2):
        rows = cut_lineage(_with_foreign(rows, percent))
    return _blocks(rows, percent)


def _with_foreign(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of which at least `percent` of the shingles stand in another component of the family too.

    Rows are dealt into chunks; a chunk sends each shingle of a family once, with the least and greatest component that
    has it, by ranges of its hash, and hears which of its shingles have several.
    """
    total = (rows.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES + 1
    bits = (2 * total).bit_length()
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("rep", "n"), F.lit(total)))
    keys = lambda t: np.concatenate([mix(np.frombuffer(h, np.uint64) ^ mix(np.full(1, f, np.int64).view(np.uint64))) for h, f in zip(t["hashes"].to_pylist(), t["family"].to_pylist(), strict=True)])

    def least_and_most(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        return key[order][first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

    def send(t: pa.Table) -> pa.Table:
        own = np.repeat(t["component"].to_numpy(), t["n"].to_numpy())
        key, low, high = least_and_most(keys(t), own, own)
        edge = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edge = np.append(edge, len(key))
        full = np.flatnonzero(np.diff(edge)).tolist()
        cut = lambda x: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()] * len(full), pa.int64()), "place": pa.array(full, pa.int32()), "keys": cut(key), "low": cut(low), "high": cut(high)})

    def meet(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        low, high = (np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in ("low", "high"))
        key, low, high = least_and_most(np.concatenate(parts), low, high)
        key = key[low != high]
        met = [np.intersect1d(x, key, assume_unique=True).tobytes() for x in parts]
        return pa.table({"chunk": t["chunk"], "keys": pa.array(met, pa.binary())})

    def keep(t: pa.Table, told: pa.Table) -> pa.Table:
        names = [c for c in t.column_names if c != "chunk"]
        if not t.num_rows:
            return t.select(names)
        n = t["n"].to_numpy()
        foreign = np.add.reduceat(np.isin(keys(t), np.frombuffer(b"".join(told["keys"].to_pylist()), np.uint64)).astype(np.int64), np.cumsum(n) - n)
        return t.select(names).filter(pa.array(100 * foreign >= percent * n))

    sent = dealt.groupBy("chunk").applyInArrow(send, "chunk long, place int, keys binary, low binary, high binary")
    told = sent.groupBy("place").applyInArrow(meet, "chunk long, keys binary")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(keep, rows.schema)


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Holds the odd rows of every family (those outside its largest component) against all of its rows: links (a, b), a
    spanning forest of the components for each block."""
    sizes = rows.groupBy("family", "component").agg(F.sum("n").alias("size"))
    sizes = cut_lineage(sizes.groupBy("family").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most")).where("most < all"))
    some = F.broadcast(sizes) if sizes.count() <= BROADCAST_FAMILIES // 4 else sizes
    count = lambda c: F.floor(c / BLOCK_SHINGLES).cast("int") + 1
    rows = rows.join(some, "family").withColumns({"odd": F.col("component") != F.col("largest"), "down": count(F.col("all") - F.col("most")), "right": count(F.col("all"))})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("rep", "n", F.lit(seed)), F.col(n)).cast("int")
    columns = ["family", "rep", "component", "n", "hashes"]
    left = rows.where("odd").select(*columns, "odd", own("down", 0).alias("i"), every("right").alias("j"))
    right = rows.select(*columns, F.lit(False).alias("odd"), own("right", 1).alias("j"), every("down").alias("i"))

    def hold(t: pa.Table) -> pa.Table:
        rep, component, n, odd = (t[c].to_numpy() for c in ("rep", "component", "n", "odd"))
        sets = [np.frombuffer(v, np.uint64) for v in t["hashes"].to_pylist()]
        distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.cumsum(n) - n
        y = np.flatnonzero(~odd)
        theirs = np.concatenate([number[edge[q] : edge[q] + n[q]] for q in y]) if len(y) else number[:0]
        begin, mark, root, out = np.cumsum(n[y]) - n[y], np.zeros(len(distinct), bool), {}, []

        def top(v: int) -> int:
            while root.get(v, v) != v:
                v = root[v] = root.get(root[v], root[v])
            return v

        for k in np.flatnonzero(odd).tolist() if len(y) else []:
            mine = number[edge[k] : edge[k] + n[k]]
            mark[mine] = True
            both = np.add.reduceat(mark[theirs], begin, dtype=np.int64)
            mark[mine] = False
            for q in y[(100 * both >= percent * (n[k] + n[y] - both)) & (component[y] != component[k])].tolist():
                one, two = top(int(component[k])), top(int(component[q]))
                if one != two:
                    root[one] = two
                    out.append((int(rep[k]), int(rep[q])))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return left.unionByName(right).groupBy("family", "i", "j").applyInArrow(hold, "a long, b long")


def keep_one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, whose document is the smallest of its component; of rows that share a doc_id one stays.

    Rows with a null doc_id all stay.
    """
    found = near_duplicates(df, doc_id, text, **options)
    drop = cut_lineage(found.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("kept").alias("kept")).where("doc_id is not null and (times > 1 or not kept)"))
    name = "`" + doc_id.replace("`", "``") + "`"
    other = fresh(df, "other")
    lost = drop.where("not kept").select(F.col("doc_id").alias(other))
    left = df.join(lost, F.col(name) == F.col(other), "left_anti")
    repeated = drop.where("kept").select(F.col("doc_id").alias(other))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, F.col(name) == F.col(other), "left_semi").dropDuplicates([doc_id])
    return left.join(repeated, F.col(name) == F.col(other), "left_anti").unionByName(once)
