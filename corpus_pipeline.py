"""Training corpus pipeline: quality, near duplicates, benchmark texts, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the docs of the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poledger.llm import decontaminate, mixing, ngram_join, quality, sharding
from poledger.plans.staging import settle

SHARDS = 16


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine, learnt from a bounded sample of labels, accepts."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return ngram_join.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark text."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard of each."""
    return sharding.with_shards(docs, [1.0] * SHARDS)


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("mix", mixed_sources),
    ("shards", in_shards),
]

#: The learnt classifier and the similarity join have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
