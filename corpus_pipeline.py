"""A training-data pipeline in five stages, each an operator of barloom.llm on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, language, mixing, near_duplicates, sharding
from barloom.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that is learned from, go."""
    return language.reject(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return near_duplicates.deduplicate(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words go."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; every row has a draw of its own."""
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards in shuffled order."""
    return sharding.shuffle_into_shards(docs, 16)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]
#: The language model is trained, so no SQL tells what the first stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
