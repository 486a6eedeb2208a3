"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, shards.

Every stage takes what its predecessor kept, as a written table, and all but the last return the columns of
``documents``. The last gives one row per taken copy of a document with its shard and its slot there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tussis.llm import decontamination, mixing, quality, sharding, simhash
from tussis.llm.common import written
from tussis.plans.registry import query, table

#: The stages use chance by hash and 64-bit fingerprints that SQL lacks; tests compare them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a similarity of 0.8 or more on shingles of five words."""
    return simhash.keep_similar(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mix", mix_sources),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


@query("pipeline", ORACLE_SQL)
def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
