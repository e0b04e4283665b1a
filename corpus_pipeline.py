"""The corpus pipeline: quality rules, near-duplicates, substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and, but for the last, returns the columns of docs:
rows that the quality rules keep, one row of each group of near-duplicates (5-word shingles, likeness 0.8 or more), texts without repeated passages, rows as often as
the mix takes them. The last gives the pieces of packed sequences. Nulls, repeated rows, empty tables and further columns
are handled as the operators' docstrings say. A document that loses every word stays until the mix takes it zero times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, quality_rules, simhash, substring_dedup
from tessera.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Fingerprint components, pivotal rounding and tokenising have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
