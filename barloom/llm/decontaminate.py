"""Benchmark decontamination: an exact containment join of item-sized windows with documents, by prefix filtering.

A window (10 consecutive item words; all words of a shorter item) is a set of single-word shingles at fixed offsets.
Containment needs all of them, so the prefix of a window in order of rarity is one word: its rarest in the documents.
1. One pass counts in how many places the documents have each word of the benchmark.
2. A second pass meets the rarest word of every window at every place in a document, derives where the window would
   start, checks that it lies within the document, and compares all words. Windows with a word that no document has drop out.
3. Words in the intervals of each document are counted; items are joined to the windows that occur.

The index of windows is broadcast if it has at most `BROADCAST_WINDOWS` rows of bounded length. A larger benchmark goes
through shuffles instead: places of words are joined without the texts, and the texts once, to the candidates. Its words
are broadcast up to `BROADCAST_WORDS` of bounded length, so that only places of indexed words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, renamed
from .native import letter_words, postings, same_row, stands_at, with_row_key

WINDOW = 10
BROADCAST_WINDOWS = 100_000
BROADCAST_WORDS = 1_000_000
#: Characters of the longest window that is broadcast; with this a broadcast index is bounded in bytes.
BROADCAST_CHARS = 500


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item, window): all windows of all items, each once for an item."""
    words = items.select(F.col("item"), letter_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return words.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), width).alias("window")).distinct()


def benchmark_hits(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row for each row of `df`: doc_id, print (a hash of the text), n_words, n_hit (words in any occurrence of a
    window), hits (distinct intervals [start, end) of words, one for each window that stands there), n_items and items (distinct ids as sorted strings).

    Null and empty texts have no words and no hits, a null or empty item has no windows; an item with a null id makes
    hits but is not listed. Of equally rare words of a window the first by alphabet, then by place, is looked up. Repeated rows are returned as often as they come. Other columns, whatever their names, are not read.
    """
    docs = renamed(df, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("print"), letter_words(F.col("text")).alias("words"))
    windows = cut_lineage(item_windows(renamed(items, item=item_id, text=item_text), width))
    distinct = windows.select("window").distinct()
    vocabulary = cut_lineage(distinct.select(F.explode("window").alias("word")).distinct())
    bound = distinct.agg(F.count("*"), F.max(F.length(F.array_join("window", " ")))).first()
    small = bound[0] <= broadcast_windows and (bound[1] or 0) <= BROADCAST_CHARS
    known = vocabulary.agg(F.count("*"), F.max(F.length("word"))).first()
    few = F.broadcast if known[0] <= broadcast_words and (known[1] or 0) <= BROADCAST_CHARS else lambda x: x
    rarity = docs.select(F.explode("words").alias("word")).join(few(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    ranked = distinct.select("window", F.posexplode("window").alias("offset", "word")).join(few(rarity), "word", "left")
    index = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "word", "offset")).alias("first"))
    index = cut_lineage(index.where("first.places > 0").select("window", "first.word", "first.offset"))
    none = index.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("window"), F.lit("").alias("word"), F.lit(0).alias("offset"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    if small:
        places = postings(docs.withColumn("n_words", F.size("words")), "words").join(F.broadcast(index.unionByName(none)), "word")
        found = places.where(F.col("window").isNull() | (fits & stands_at(F.col("words"), start, F.col("window")))).select("doc_id", "print", "n_words", "window", start.alias("start"))
    else:
        places = docs.select("doc_id", "print", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "word"))
        places = places.join(few(index.select("word").distinct()), "word", "left_semi")
        near = places.join(index, "word").where(fits).select("doc_id", "print", "window", start.alias("start"))
        maybe = near.groupBy("doc_id", "print").agg(F.collect_set(F.struct("window", "start")).alias("maybe"))
        maybe = maybe.toDF("own_id", "own_print", "maybe")
        read = docs.join(maybe, same_row(docs, maybe, ["doc_id", "print"], ["own_id", "own_print"])).select("doc_id", "print", F.size("words").alias("n_words"), "words", F.explode("maybe").alias("m"))
        read = read.where(stands_at(F.col("words"), F.col("m.start"), F.col("m.window"))).select("doc_id", "print", "n_words", "m.window", "m.start")
        every = docs.select("doc_id", "print", F.size("words").alias("n_words"), F.lit(None).cast("array<string>").alias("window"), F.lit(0).alias("start"))
        found = every.unionByName(read)
    hit = F.when(F.col("window").isNotNull(), F.struct("start", (F.col("start") + F.size("window")).alias("end")))
    which = F.when(F.col("window").isNotNull(), F.col("window"))
    rows = cut_lineage(found.groupBy("doc_id", "print").agg(F.max("n_words").cast("long").alias("n_words"), F.sum(F.col("window").isNull().cast("int")).cast("int").alias("times"), F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set(which).alias("windows")))
    listed = rows.where("size(windows) > 0").select("doc_id", "print", F.explode("windows").alias("window")).join(windows.where("item is not null"), "window").groupBy("doc_id", "print").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    listed = listed.toDF("own_id", "own_print", "items")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda done, h: F.struct(F.greatest(done["end"], h["end"]).alias("end"), (done["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(done["end"], h["start"]))).alias("n")),
        lambda done: done["n"].cast("long"),
    )
    out = rows.join(listed, same_row(rows, listed, ["doc_id", "print"], ["own_id", "own_print"]), "left")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    out = out.select("doc_id", "print", "n_words", covered.alias("n_hit"), "hits", F.size(items).cast("long").alias("n_items"), items.alias("items"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return out.drop("copy")


def drop_contaminated(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, in which no window of the benchmark occurs. Rows of null or empty text stay."""
    keyed, keys = with_row_key(df, doc_id, text)
    bad = benchmark_hits(df, items, doc_id, text, **options).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("print").alias("bad_print")).distinct()
    bad = bad.toDF(*(k + "_bad" for k in keys))
    return keyed.join(bad, same_row(keyed, bad, keys, bad.columns), "left_anti").drop(*keys)
