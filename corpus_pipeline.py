"""The corpus pipeline: five operators one after another over whole documents.

Each stage's result is written to the shared folder and read back, so that a lost
executor costs at most one stage. Null and empty texts break the quality rules and
go; rows without a doc_id go through all stages and keep a null one; of rows equal in
doc_id and text one stays; texts of any length are taken whole. Columns beside those of
the documents table are carried along, whatever their names, up to the last stage. An
empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, decontaminate, near_dedup, pii, quality_rules
from wordloom.llm.common import source, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, source(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_level_bpe", tokens),
]

#: Near duplicates, edit distance and the trained field are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of the documents that stay."""
    docs = source(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
