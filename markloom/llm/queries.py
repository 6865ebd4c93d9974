"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import mixing
from markloom.llm.bm25 import top_documents
from markloom.llm.common import documents
from markloom.llm.fingerprints import compare_fingerprints
from markloom.llm.language_id import identify_languages
from markloom.llm.ngram_join import ngram_components
from markloom.llm.packing import pack
from markloom.llm.quality_lm import judge_quality
from markloom.llm.substring_dedup import repeated_spans
from markloom.llm.token_counts import count_tokens
from markloom.llm.toxicity import score_toxicity


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_fingerprints(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), n=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(documents(spark, sf_dir), least=50)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(documents(spark, sf_dir), every=20, k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_token_counts,
        op3_ngram_jaccard_join,
        op4_mix_sources,
        op5_suffix_array_dedup,
        op6_language_id,
        op7_best_fit_packing,
        op8_toxicity,
        op9_quality_classifier,
        op10_exact_top_k_search,
    )
}

ORACLE_SQL = {"op4_mix_sources": mixing.ORACLE}
