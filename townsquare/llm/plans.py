"""The operators bound to the sample tables, beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from townsquare.llm import (
    decontamination, extraction, langid, lexical, licenses, mixing, neardup, ngrams, oracles, quality, rules, secretscan,
    sharding, whitening,
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def quality_scores(spark, d):
    return quality.quality_digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def mixture(spark, d):
    return mixing.mix(documents(spark, d), carry=["doc_id", "source"])


def license_spans(spark, d):
    return licenses.license_rows(documents(spark, d))


def leaked_items(spark, d):
    return decontamination.leak_pairs(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def language_model(spark, d):
    return ngrams.ngram_scores(documents(spark, d).select("doc_id", "text"))


def shards(spark, d):
    return sharding.shard_digest(documents(spark, d))


def document_languages(spark, d):
    return langid.language_digest(documents(spark, d))


def near_duplicates(spark, d):
    return neardup.near_duplicates(documents(spark, d).select("doc_id", "text"))


def secret_spans(spark, d):
    return secretscan.secrets_digest(documents(spark, d))


def quality_rules(spark, d):
    return rules.rules_digest(documents(spark, d))


def page_texts(spark, d):
    return extraction.extraction_digest(spark.read.parquet(f"{d}/pages.parquet"))


def whitened(spark, d):
    return whitening.whitening_digest(spark.read.parquet(f"{d}/embeddings.parquet"))


def ranked_documents(spark, d):
    return lexical.rank_documents(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality_scores,
    "op2_mixture": mixture,
    "op3_licenses": license_spans,
    "op4_leaks": leaked_items,
    "op5_language_model": language_model,
    "op6_shards": shards,
    "op7_languages": document_languages,
    "op8_near_duplicates": near_duplicates,
    "op9_secrets": secret_spans,
    "op10_rules": quality_rules,
    "op11_main_text": page_texts,
    "op12_whitening": whitened,
    "op13_search": ranked_documents,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLES)
