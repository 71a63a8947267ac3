"""A training-corpus pipeline over ``documents``: each stage calls one operator
of ``tidepool.llm``, works on all its predecessor kept and is written as Parquet
before the next reads it.  All stages but the last return the columns of
``documents`` (extra columns travel along)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import packing, quality_rules, secrets, simhash, toxicity
from tidepool.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_by_rules(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; fitted on this stage's documents and ``labels``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows over all documents' token streams."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Judging, scoring, linking and tokenising are beyond SQL; tests hold the rows
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
