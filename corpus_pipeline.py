"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, tokenisation.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that its predecessor kept and returns
a DataFrame; all but the last return the columns of ``docs``. Nulls, empty and repeated rows and empty
tables have the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import exactdup, langid, mixing, simhash, spm
from vigil.llm.common import documents, materialize, ship_package
from vigil.llm.pieces import default_model


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or without a language that holds 0.3 of the words, go."""
    ship_package(spark)
    return langid.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exactdup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near fingerprints stays."""
    ship_package(spark)
    return simhash.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays once at least; rows of small sources come again, up to the repetition limit."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text for each row."""
    ship_package(spark)
    return spm.digests(docs, default_model())


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express language ID, SimHash and tokenisation; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written once to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
