"""The corpus pipeline: five of the operators of ``tally.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet in the shared scratch folder and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm import queries as Q
from tally.llm.common import documents, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    return Q.L3.keep_identified(docs, Q.L3.fit(docs, **Q.LANGUAGE_FIT), **Q.LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return Q.L6.keep_one(docs, **Q.SIMHASH)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return Q.L8.keep_clean(docs, Q.benchmark(spark, sf_dir), **Q.EDITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands in it as often as it was drawn."""
    return Q.L5.mix(docs, **Q.MIX)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records of the mix, as read back from their files."""
    return Q.token_records(spark, docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix", mix), ("tokenize", tokenize)]

#: Compression, SimHash and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
