"""A corpus pipeline of five stages, each one of the operators in alembiq.llm.

Every stage takes the session, its predecessor's documents and the folder of the other tables, and
returns documents; the last one returns the index of the token files it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alembiq.llm.common import table, work_path, written
from alembiq.llm.decontaminate import decontaminated
from alembiq.llm.mixing import mixed_documents
from alembiq.llm.simhash_parts import deduplicated
from alembiq.llm.token_output import read_shards, write_shards
from alembiq.llm.toxicity import clean_documents, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the lexicon is learned from the labels of the documents given."""
    return clean_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), the one of smallest doc_id."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by the target weights of their sources."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return read_shards(spark, write_shards(docs, work_path(spark, "pipeline-tokens")))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither a learned lexicon, nor components of near copies, nor a tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None
