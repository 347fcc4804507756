"""Corpus pipeline: rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, folder) and returns a DataFrame; it is written as Parquet
and read back as the next stage's ``docs``.  Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table
from tickloom.llm.decontamination import clean_documents
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.quality_rules import kept_documents
from tickloom.llm.sharding import shard
from tickloom.llm.set_dedup import without_near_copies

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the rules and whose host passes.

    A null or empty text fails; a null source has no host verdict; repeated rows are judged one by one.
    """
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Anchor points of fingerprints give the first pairs, the sets decide; links beyond two bits are searched by the sets.
    The smallest doc_id stays, null last, one of several equal rows; texts without words are one group.
    """
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark window.

    A null text has no words and stays; repeated rows are judged one by one; an empty benchmark keeps all.
    """
    return clean_documents(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix: a document stands as often as the mix takes it.

    A null source is a source, last in order; texts without words are never taken; of fully equal rows one stands for all.
    """
    return mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with struct ``placed``: shard, slot (gapless inside the shard), virtual_slot, size.

    A null text has size 1; repeated rows get slots of their own; the struct takes another name where ``placed`` is one.
    """
    rows = shard(docs, SHARDS)
    placed = F.struct("shard", F.col("slot").cast("long").alias("slot"), F.col("vslot").alias("virtual_slot"), "size")
    name = "placed"
    while name in docs.columns:
        name += "_"
    return rows.select("row.*", placed.alias(name))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Pairs of similar sets are too many for SQL on whole tables; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
