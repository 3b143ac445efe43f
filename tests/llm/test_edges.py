"""Empty tables, tables of nulls, and clashing columns through every operator and every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import byte_bpe, near_dedup, substring_dedup, token_counts, toxicity
from barloom.llm.queries import pattern, vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def empty(spark, rows=()):
    return spark.createDataFrame(list(rows), COLUMNS)


NULLS = [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0)]


@pytest.mark.parametrize("rows", [[], NULLS])
def test_operators(spark, rows):
    df, n = empty(spark, rows), len(rows)
    assert near_dedup.near_duplicates(df).count() == n
    assert substring_dedup.remove_repeated_passages(df).count() == n
    assert byte_bpe.encode_and_decode(df, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern()).where("size(bpe.ids) > 0").count() == 0
    assert token_counts.count_tokens(df, vocabulary("piece_bpe_32k.model")).where("n_tokens <> 0").count() == 0
    assert toxicity.toxicity_scores(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == n
    kept = near_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.where("doc_id IS NOT NULL").count() == len({r[0] for r in rows} - {None})


@pytest.mark.parametrize("rows", [[], NULLS])
def test_stages(spark, small, tmp_path, rows):
    docs = empty(spark, rows).withColumns({"words": F.lit(1), "kept": F.lit("x"), "passages": F.lit(2), "__chunk": F.lit(3), "__id": F.lit(4), "bpe": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
    assert spark.read.parquet(f"file://{tmp_path}/tokens").count() == len(rows)
