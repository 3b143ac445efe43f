"""The thin queries over whole tables: each calls its operator and derives the columns that are agreed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, licences, near_dedup, oracles, quality, substring_dedup, token_counts, token_files, toxicity
from .common import own_folder, shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that `labels` calls good."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "passages.n_words", "passages.n_removed", F.sha2("passages.kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_conversations(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "toxicity.held_out", "toxicity.score", "toxicity.predicted")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_labels(table(spark, sf_dir, "documents")).drop("places")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())
    ids = F.col("bpe.ids")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), own_folder(spark, "tokens"), vocabulary("byte_bpe_50k.json"), 2)
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_substring_dedup, op4_token_counts, op5_chat_collapse, op6_toxicity, op7_licence_scan, op8_byte_bpe, op9_decontamination, op10_token_files)}

ORACLES: dict[str, str] = {"op1_minhash_near_dedup": oracles.NEAR_DEDUP, "op3_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_chat_collapse": oracles.CHAT_COLLAPSE, "op7_licence_scan": oracles.licence_scan(), "op9_decontamination": oracles.DECONTAMINATION}
