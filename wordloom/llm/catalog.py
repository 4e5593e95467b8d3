"""Registered queries of the corpus operators, one opN_<name> each, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, bpe, decontaminate, language_id, near_dedup, pii, quality_classifier, quality_rules, token_counts, tool_calls
from .common import source


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(source(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(source(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extracted(source(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.fitted(docs, source(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.fitted(docs))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.transcribed(source(spark, sf_dir, "conversations"))


def op7_generated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(tool_calls.generated(source(spark, sf_dir, "conversations")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(source(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_twice(source(spark, sf_dir, "documents"), token_counts.new_cache(spark))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(source(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_pii, op2_benchmark_decontamination, op3_quality_rules, op4_html_extraction, op5_quality_classifier, op6_language_id, op7_tool_calls, op7_generated_calls, op8_simhash_near_dedup, op9_token_counts, op10_byte_level_bpe)}

ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.oracle(), "op7_tool_calls": tool_calls.whole_oracle(), "op7_generated_calls": tool_calls.generated_oracle()}
