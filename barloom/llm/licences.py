"""Licence scans by a positional rare-token index over known notices.

1. One pass counts in how many documents each word of the notices occurs (its IDF follows; 0 for a word that none has).
2. The index lists the `RARE` highest-IDF places of every notice: words with their offsets in it.
3. A second pass looks up, of a file's licence words, those that are among the highest-IDF ones of any notice, so that a
   file with several notices loses none. A match says where the notice would start; matches that agree on notice and
   start are intersected. An alignment counts if the notice's mandatory key phrase stands at its place there and enough
   of the indexed places are aligned (by IDF); it may begin before the file, as long as the key phrase lies in it.
Plain phrases are notices of their own, whose key phrase is all of them. A label has several notices: grant lines, titles
and passages of the licence's own text.

The notices are a fixed table, so the index is broadcast at any size of the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, renamed
from .native import letter_words, literal, postings, stands_at

# Phrases and the labels that they are agreed to give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, notice, mandatory key phrase in it).
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "Apache License Version 2.0", "apache license version 2 0"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2", "general public license version 2"),
    ("gpl-2.0", "GNU General Public License version 2", "general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general public license version 3"),
    ("gpl-3.0", "GNU General Public License version 3", "general public license version 3"),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1", "lesser general public license"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3", "affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0", "mozilla public license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "BSD 2-Clause License", "bsd 2 clause license"),
    ("bsd", "BSD 3-Clause License", "bsd 3 clause license"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "released into the public domain"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
]
#: Indexed places of a notice, and the share of their IDF that an alignment needs.
RARE, SHARE = 4, 0.6
_ENTRY = "array<struct<entry: int, label: string, base: boolean, words: array<string>, key: array<string>, key_at: int>>"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _entries() -> list[dict]:
    out = []
    for label, notice, key in NOTICES:
        words, phrase = _words(notice), _words(key)
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append({"label": label, "base": False, "words": words, "key": phrase, "key_at": at})
    out += [{"label": label, "base": True, "words": _words(p), "key": _words(p), "key_at": 0} for p, label in PHRASES.items()]
    return [{"entry": k, **e} for k, e in enumerate(out)]


def licence_labels(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE, share: float = SHARE) -> DataFrame:
    """One row for each row of `df`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. n_base counts the places where the
    words of a plain phrase stand consecutively, first_word and last_word are the least and greatest of their starts
    (null without any), base_labels the distinct labels, sorted and comma-joined. labels adds the notices that are found;
    places lists them all as (label, start); a start is below 0 where the file begins inside a notice. Of indexed places with
    equal IDF the first word by alphabet, then the first offset, is taken. score is the largest aligned share of a notice's indexed IDF, 0 without any.
    Null and empty texts have no words and labels ''. Repeated rows are returned as often as they come; other columns,
    whatever their names, are not read.
    """
    spark = df.sparkSession
    docs = renamed(df, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("print"), letter_words(F.col("text")).alias("words"))
    entries = spark.range(1).select(F.inline(literal(_entries(), _ENTRY)))
    own = ["entry", "label", "base", "key", "key_at"]
    tokens = entries.select(*own, F.posexplode("words").alias("offset", "word"))
    vocabulary = tokens.select("word").distinct()
    seen = docs.select(F.explode(F.array_intersect("words", literal(sorted({w for e in _entries() for w in e["words"]}), "array<string>"))).alias("word"))
    spread = seen.groupBy("word").agg(F.count("*").alias("docs"))
    idf = F.coalesce(F.ln(F.lit(docs.select("doc_id").count() + 1.0) / (F.col("docs") + 1.0)), F.lit(0.0))  # a word that no file has finds nothing
    idf = cut_lineage(vocabulary.join(spread, "word", "left").select("word", idf.alias("idf")))
    weighed = tokens.join(F.broadcast(idf), "word").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("order"), "word", "offset"))).alias("all"))
    chosen = weighed.withColumn("best", F.slice("all", 1, F.when(F.col("base"), 1).otherwise(rare)))
    chosen = chosen.withColumn("sum", F.aggregate("best", F.lit(0.0), lambda s, x: s - x["order"]))
    part = F.when(F.col("sum") > 0, -F.col("b.order") / F.col("sum")).otherwise(F.lit(1.0) / F.col("of"))
    index = cut_lineage(chosen.select(*own, F.size("best").alias("of"), F.explode("best").alias("b"), "sum").select(*own, "b.word", "b.offset", part.alias("part")))
    none = spark.range(1).select(F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(None).cast("array<string>").alias("key"), F.lit(0).alias("key_at"), F.lit("").alias("word"), F.lit(0).alias("offset"), F.lit(0.0).alias("part"))
    start = F.col("at") - F.col("offset")
    met = postings(docs.withColumn("n_words", F.size("words")), "words").join(F.broadcast(index.unionByName(none)), "word")
    met = met.where(F.col("entry").isNull() | stands_at(F.col("words"), start + F.col("key_at"), F.col("key")))
    met = met.groupBy("doc_id", "print", "n_words", "entry", "label", "base", start.alias("start"), "offset").agg(F.max("part").alias("part"), F.count("*").cast("int").alias("times"))
    aligned = met.groupBy("doc_id", "print", "n_words", "entry", "label", "base", "start").agg(F.round(F.sum("part"), 9).alias("share"), F.max("times").alias("times"))
    aligned = aligned.where(F.col("entry").isNull() | F.col("base") | (F.col("share") >= share))
    place = F.when(F.col("label").isNotNull(), F.struct("label", "start"))
    base = F.when(F.col("base"), F.col("start"))
    rows = aligned.groupBy("doc_id", "print").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"), F.array_sort(F.collect_set(place)).alias("places"), F.max(F.when(F.col("entry").isNull(), F.col("times"))).alias("times"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("print", "times", "copy")
