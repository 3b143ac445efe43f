"""Quality rules: a length-normalised log-likelihood ratio of hashed n-grams, trusted documents against the raw corpus.

Words and pairs of adjacent words are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted in one pass: of all documents, and of the trusted ones. A document's score is the mean over its n-grams of
log p(trusted) - log p(raw); every document is held against the same threshold. Both sides count all of their documents.
The trusted ids are broadcast up to `BROADCAST_IDS` and joined by a shuffle beyond. The bucket weights are a fixed number
of doubles and reach the scoring plan as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, renamed
from .native import plain_words

BUCKETS = 1 << 14
THRESHOLD = -0.1
BROADCAST_IDS = 1_000_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _ngrams(words: Column, buckets: int) -> Column:
    """The buckets of all words, then those of all pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def bucket_weights(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight) for every bucket: the log ratio of its shares in the trusted and in all documents, one added to each count.

    `trusted` has one column of ids. An empty corpus or no trusted documents give weights of 0 (equal shares).
    """
    docs = renamed(df, id=doc_id, text=text)
    ids = trusted.toDF("good").where("good is not null").distinct()
    marked = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("id") == F.col("good"), "left")
    grams = marked.select(F.col("good").isNotNull().cast("long").alias("in_trusted"), F.explode(_ngrams(plain_words(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("in_trusted").alias("target"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = cut_lineage(every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))
    n = filled.agg(F.sum("raw"), F.sum("target")).first()
    weight = F.ln((F.col("target") + 1.0) / F.lit(n[1] + float(buckets))) - F.ln((F.col("raw") + 1.0) / F.lit(n[0] + float(buckets)))
    return filled.select("bucket", (weight if n[1] else F.lit(0.0)).alias("weight"))


def quality_scores(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "quality", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `df` and a struct `into`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    llr (null without n-grams) and kept.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. word_chars counts code points in words; n_symbols the
    characters `[#*$%&|<>]`; n_dup_lines the lines with a word that equal an earlier one; n_repeat_words the words in
    5-word windows found twice or more (windows are told apart by 64-bit hashes). base_failed: under 10 words, or over 20
    in 100 words repeated. kept: not base_failed and llr >= threshold. A column called like `into` is replaced, other
    columns and repeated rows stay; the verdict on a row depends on its text alone once the weights are counted.
    """
    if into in df.columns:
        df = df.drop(into)
    own = "`" + text.replace("`", "``") + "`"
    a, b, c, d, e = (fresh(df, x) for x in ("words", "windows", "weights", "repeat", "n"))
    t = F.coalesce(F.col(own), F.lit(""))
    weights = bucket_weights(df, trusted, doc_id, text, buckets).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("weights")).scalar()
    words = df.withColumns({a: plain_words(F.col(own)), c: weights})
    hashed = F.transform(a, lambda w: F.xxhash64(w))
    windows = F.when(F.size(a) >= REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), F.size(a) - REPEAT_WINDOW + 1), lambda i: F.xxhash64(*(F.get(b, i + (k - 1)) for k in range(REPEAT_WINDOW)))))
    step = words.withColumn(b, hashed).withColumn(b, windows)
    step = step.withColumn(d, F.when(F.size(F.array_distinct(b)) < F.size(b), F.array_sort(F.transform(b, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    twin = lambda x, i: (F.get(d, i - 1)["h"] == x["h"]) | (F.get(d, i + 1)["h"] == x["h"])
    step = step.withColumn(d, F.when(F.col(d).isNotNull(), F.array_sort(F.transform(F.filter(d, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["at"]))))
    repeated = F.aggregate(
        d,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda done, at: F.struct((at + REPEAT_WINDOW).alias("end"), (done["n"] + REPEAT_WINDOW - F.greatest(F.lit(0), done["end"] - at)).alias("n")),
        lambda done: done["n"].cast("long"),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    grams = _ngrams(F.col(a), buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(c, g))
    n = F.size(a).cast("long")
    step = step.withColumn(e, F.struct(n.alias("n"), F.coalesce(repeated, F.lit(0).cast("long")).alias("repeat"), F.when(n > 0, total / (2 * n - 1)).alias("llr"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("unlike")))
    s = F.col(e)
    failed = (s["n"] < MIN_WORDS) | (100 * s["repeat"] > MAX_REPEAT_PERCENT * s["n"])
    fields = {"n_words": s["n"], "word_chars": F.length(F.array_join(a, "")).cast("long"), "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"), "n_dup_lines": (s["lines"] - s["unlike"]).cast("long"), "n_repeat_words": s["repeat"], "base_failed": failed, "llr": s["llr"], "kept": ~failed & F.coalesce(s["llr"] >= threshold, F.lit(False))}
    return step.select(*("`" + x.replace("`", "``") + "`" for x in df.columns), F.struct(*(v.alias(k) for k, v in fields.items())).alias(into))


def drop_low_quality(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, that quality_scores keeps.

    The test holds a part that the optimizer may not move, or it would write out the whole tree of expressions in the filter.
    """
    verdict, kept = fresh(df, "verdict"), fresh(df, "kept")
    scored = quality_scores(df, trusted, doc_id, text, verdict, **options)
    return scored.withColumn(kept, F.col(verdict)["kept"] & (F.monotonically_increasing_id() >= 0)).where(F.col(kept)).drop(verdict, kept)
