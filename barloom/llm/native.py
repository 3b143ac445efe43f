"""Words as built-in Column expressions: everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does it for texts that are ASCII as a whole, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def plain_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def letter_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def literal(value: list | tuple | dict | str, kind: str) -> Column:
    """A constant that the optimizer folds."""
    import json

    return F.from_json(F.lit(json.dumps(value)), kind)


def postings(docs: DataFrame, words: str) -> DataFrame:
    """One row for each word of each row of `docs`: all columns, `at` (from 0) and `word`, and a last one with the empty
    word, which no text has, so that a row without any match still comes through a join with an index that lists it.

    The array of words stays a column. An index must be joined by broadcast: then join and generator are one stage of
    generated code, and the array is passed on by reference and copied for matching rows only.
    """
    return docs.select("*", F.posexplode(F.array_append(words, F.lit(""))).alias("at", "word"))


def stands_at(words: Column, start: Column, phrase: Column) -> Column:
    """Whether the words of `phrase` stand in `words` from place `start` (from 0) on; bounds first, so a null start is false."""
    return F.coalesce((start >= 0) & (start + F.size(phrase) <= F.size(words)) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase), F.lit(False))


def with_row_key(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """The frame and two key columns in it, by which results are joined back: the id and a hash of the text."""
    a = fresh(df, "id")
    b = fresh(df, "print")
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.withColumns({a: q(doc_id), b: F.xxhash64(q(text))}), [a, b]


def same_row(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> Column:
    """Equality of keys in which nulls are equal; still an equi-join to Spark."""
    out = F.lit(True)
    for a, b in zip(keys, names, strict=True):
        out = out & left[a].eqNullSafe(right[b])
    return out
