"""Queries that apply each corpus operator to its whole table.

Their results are digests of iterative or order-dependent algorithms, which SQL on whole
tables can't express, so ``oracle_sql`` is empty; tests compare each query with brute force,
an exact round trip or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulespan.llm.common import read


def op1_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.substring import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.embedding import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rulespan.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.ngram import train_and_score

    return train_and_score(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.jaccard import join_components

    return join_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.html import extract

    return extract(read(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.media import media_table

    return media_table(read(spark, sf_dir, "documents"))


def op9_quality_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.suffix_dedup import dedup_suffixes

    return dedup_suffixes(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_rlz_substring_dedup,
            op2_itq_near_dedup,
            op3_sum_of_squares_packing,
            op4_elias_fano_lm,
            op5_ngram_jaccard_join,
            op6_template_extraction,
            op7_mix_sources,
            op8_media_columns,
            op9_quality_posteriors,
            op10_suffix_array_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {}
