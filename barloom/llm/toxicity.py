"""Toxicity by class-conditional Kneser-Ney models of whole words that back off to their stems.

Two models, of toxic and of ordinary documents, give every word its probability. The highest order counts the documents
that hold the word, the lower one (its first `STEM` bytes) the distinct words of the class that begin so (Kneser-Ney
continuations); both take off an absolute discount. The weight of the lower order, and the uniform share below it, are the
same for both classes, so a word that neither class has seen has the difference of its stem, and without a seen stem none.

A document's evidence is the sum over its distinct words of the cube of the difference of log-probabilities, over the
root of their number plus 1: many small differences, which chance makes, stay small beside a few large ones. It is put
through a logistic curve that is fitted on labelled documents which the counts have not seen.

Counts come from all labelled documents outside the held-out fold and the curve's fold, and all of their words. A table
of at most `BROADCAST_WORDS` words is broadcast; a larger one is joined to the words of the documents by shuffles. Labels
are broadcast up to `BROADCAST_LABELS` and joined by a shuffle beyond. Only the two numbers of the curve come from a sample, of at most
`MAX_DOCS` documents (those with the least hashed ids). All documents are scored on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, blocks, fingerprints, flat, lean, table_of, words
from .common import cut_lineage, numbered, renamed, schema_with

STEM, DISCOUNT, BACKOFF, UNIFORM = 6, 0.75, 16.0, 16.0
MAX_DOCS, BROADCAST_WORDS, BROADCAST_LABELS = 6_000, 4_000_000, 1_000_000
_SPLIT = table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _vocabularies(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: its range, the fingerprints of its distinct words and of their stems, and as pairs
    (text, word), each once, which text holds which word."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        own = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = words(own, offsets[i : j + 1] - offsets[i], _SPLIT)
        distinct, at, row = np.unique(fingerprints(own, starts, ends).view(np.int64), return_index=True, return_inverse=True)
        stems = fingerprints(own, starts[at], np.minimum(ends[at], starts[at] + STEM)).view(np.int64)
        pairs = np.unique(np.repeat(np.arange(j - i), np.diff(first)) * max(len(distinct), 1) + row)
        yield i, j, distinct, stems, pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted keys, and their values."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at].astype(np.float64)


@dataclass
class Model:
    """Differences by word and by stem, as sorted arrays; or, without arrays, only in the tables."""

    words: tuple[np.ndarray, np.ndarray] | None
    stems: tuple[np.ndarray, np.ndarray] | None
    curve: tuple[float, float] = (1.0, 0.0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        out = []
        for i, j, distinct, stems, text, word in _vocabularies(column):
            known, value = _found(*self.words, distinct)
            like, backed = _found(*self.stems, stems)
            cubes = np.where(known, value, np.where(like, backed, 0)) ** 3
            n = np.bincount(text, minlength=j - i)
            out.append(np.bincount(text, cubes[word], j - i) / np.sqrt(n + 1))
        return np.concatenate(out) if out else np.zeros(0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a weak pull of the slope to 1 for evidence of deviation 1."""
    scale = float(x.std()) or 1.0
    x, a, b = x / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a) / scale, float(b)


def _counted(docs: DataFrame) -> DataFrame:
    """(word, stem, ordinary, toxic) of docs (y, text): in how many documents of each class each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for i, j, distinct, stems, text, word in _vocabularies(batch.column(1)):
                toxic = y[i:j][text] == 1
                n = [np.bincount(word[mine], minlength=len(distinct)) for mine in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(stems), *map(pa.array, n)], ["word", "stem", "ordinary", "toxic"])

    each = docs.select("y", "text").mapInArrow(lean(run), "word long, stem long, ordinary long, toxic long")
    return each.groupBy("word").agg(F.min("stem").alias("stem"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _differences(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, value) and (stem, value): log p(toxic) - log p(ordinary)."""
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    n = counted.agg(F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1"), kinds("ordinary").alias("k0"), kinds("toxic").alias("k1")).first()
    less = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))

    def q(c: str, k: int) -> Column:
        return less(c) / F.lit(float(k or 1)) * F.lit((n.k0 + n.k1) / UNIFORM) + 1.0

    stems = counted.groupBy("stem").agg(kinds("ordinary").alias("s0"), kinds("toxic").alias("s1"))
    stems = stems.select("stem", q("s0", n.k0).alias("q0"), q("s1", n.k1).alias("q1"))
    share = BACKOFF * 2 / (n.n0 + n.n1)
    p = lambda c, total, own: less(c) / F.lit(float(total or 1)) + F.lit(share) * F.col(own) / (F.col("q0") + F.col("q1"))
    value = F.ln(p("toxic", n.n1, "q1")) - F.ln(p("ordinary", n.n0, "q0"))
    return counted.join(stems, "stem").select("word", value.cast("float").alias("value")), stems.select("stem", F.ln(F.col("q1") / F.col("q0")).cast("float").alias("value"))


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.toArrow()
    key, value = rows[table.columns[0]].to_numpy(), rows["value"].to_numpy()
    order = np.argsort(key)
    return key[order], value[order]


def _evidence(docs: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, print, evidence) of docs (key, print, text), both longs that tell texts apart, by shuffles: for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, distinct, stems, text, word in _vocabularies(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i).take(pa.array(text)) for c in batch.columns[:2]), pa.array(distinct[word]), pa.array(stems[word])], ["key", "print", "word", "stem"])

    pairs = docs.mapInArrow(lean(run), "key long, print long, word long, stem long").distinct()
    one, two = tables[0].withColumnRenamed("value", "own"), tables[1].withColumnRenamed("value", "backed")
    value = F.coalesce("own", "backed", F.lit(0.0)).cast("double")
    met = pairs.join(one, "word", "left").join(two, "stem", "left")
    return met.groupBy("key", "print").agg((F.sum(value * value * value) / F.sqrt(F.count("*") + 1)).alias("evidence"))


def _prints(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _sample(labels: DataFrame, n: int) -> DataFrame:
    return labels.where("fold = 1").orderBy(F.xxhash64("label_id"), "label_id").limit(n)


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS, broadcast_words: int = BROADCAST_WORDS) -> tuple[Model, tuple[DataFrame, DataFrame]] | None:
    """The model from the rows of `labels` whose crc32(doc_id as text) mod 5 is not 0: 2-4 are counted, 1 fits the curve; and its tables.

    Null labels and ids are left out; an id that is labelled twice is toxic if either label is. None if a class is missing.
    """
    fold = F.pmod(F.crc32(F.col("label_id").cast("string")), F.lit(5))
    known = renamed(labels, label_id=doc_id, y=label).where("label_id is not null and y is not null").groupBy("label_id").agg(F.max("y").cast("int").alias("y")).withColumn("fold", fold)
    known = cut_lineage(known.where("fold <> 0"))
    sizes = {r["y"]: r["n"] for r in known.where("fold >= 2").groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    if not sizes.get(0) or not sizes.get(1):
        return None
    docs = renamed(df, id=doc_id, text=text)
    counts = known.where("fold >= 2")
    picked = F.broadcast(counts) if sum(sizes.values()) <= BROADCAST_LABELS else counts
    counted = cut_lineage(_counted(docs.join(picked, F.col("id") == F.col("label_id"))))
    tables = tuple(cut_lineage(x) for x in _differences(counted))
    small = counted.count() <= broadcast_words
    model = Model(_sorted(tables[0]), _sorted(tables[1])) if small else Model(None, None)
    picked = F.broadcast(_sample(known, max_docs))
    some = docs.join(picked, docs["id"] == picked["label_id"]).select("y", "text")
    if model.words is None:
        keyed = some.select("y", *(c.alias(n) for c, n in zip(_prints(F.col("text")), ("key", "print"), strict=True)), "text")
        seen = keyed.drop("text").join(_evidence(keyed.drop("y"), tables), ["key", "print"], "left").select("y", F.coalesce("evidence", F.lit(0.0)).alias("evidence")).toArrow()
    else:
        sent = df.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.evidence(batch.column(1)), pa.float64())], ["y", "evidence"])

        seen = some.mapInArrow(lean(run), "y int, evidence double").toArrow()
    if seen.num_rows:
        model.curve = _logistic(seen["evidence"].to_numpy(), seen["y"].to_numpy())
    return model, tables


def toxicity_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", into: str = "toxicity", max_docs: int = MAX_DOCS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """All columns of `df` and a struct `into`: held_out (crc32 of the id as text is 0 mod 5; null for a null id), score, predicted.

    score is from 0 to 1, higher for toxic; it depends on the text alone. Null and empty texts get the curve's value for no
    evidence; without labelled documents of both classes all scores are 0. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
    with A-Z lower-cased. A column called like `into` is replaced; others, and repeated rows, stay.
    """
    trained = train(df, labels, doc_id, text, label, max_docs, broadcast_words)
    number = df.columns.index(doc_id)
    df, names, text = numbered(df, into, text)
    into = "result"
    held = F.pmod(F.crc32(F.col(f"c{number}").cast("string")), F.lit(5)) == 0
    if trained is None:
        return df.withColumn(into, F.struct(held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))).toDF(*names)
    model, tables = trained
    if model.words is None:
        a, b = model.curve
        keyed = df.withColumns(dict(zip(("key", "print"), _prints(F.coalesce(F.col(text), F.lit(""))), strict=True)))
        found = _evidence(keyed.select("key", "print", text), tables)
        logit = F.lit(a) * F.coalesce("evidence", F.lit(0.0)) + F.lit(b)
        scored = keyed.join(found, ["key", "print"], "left").select(*df.columns, (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))).alias(into))
    else:
        sent = df.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = sent.value.curve
            for batch in batches:
                x = sent.value.evidence(batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(a * x + b, -500, 500))), pa.float64())], [*batch.schema.names, into])

        scored = df.mapInArrow(lean(run), schema_with(df, **{into: "double"}))
    score = F.col(into)
    return scored.withColumn(into, F.struct(held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))).toDF(*names)
