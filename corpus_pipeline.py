"""A corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir); its rows are written and read again as the next one's documents. All but the last
keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, decontaminate, near_dedup, quality, substring_dedup
from barloom.llm.common import fresh, own_folder, table
from barloom.llm.queries import pattern, trusted_ids, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the threshold."""
    return quality.drop_low_quality(docs, trusted_ids(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return near_dedup.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words that stand anywhere else too; n_chars follows, and untouched texts stay as they are."""
    found = fresh(docs, "passages")
    out = substring_dedup.remove_repeated_passages(docs, into=found)
    cut = F.col(found)["n_removed"] > 0
    text = F.when(cut, F.col(found)["kept"]).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(cut, F.length(F.col(found)["kept"]).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.withColumns(new).drop(found)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the decoded ids are the text's bytes again."""
    out = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())
    back = F.col("bpe.decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", F.size("bpe.ids").cast("long").alias("n_tokens"), F.col("bpe.ids").alias("ids"), back.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: No SQL tells the stages' hashes and byte pairs; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = own_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
