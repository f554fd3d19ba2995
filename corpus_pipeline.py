"""From raw documents to training shards, in five written stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on, with their columns. The last one adds shard
and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewright.llm import decontamination, mixing, near_dedup, quality, sharding
from lanewright.llm.common import materialise

#: Word shingles and similarity in percent from which documents are one group.
SHINGLE, SIMILAR = 5, 80
SHARDS = 40


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. The model is
    learnt from the labelled rows of ``docs``. Null and empty texts get the
    score of the bias alone; repeated rows are judged alike; without usable
    labels of both classes all rows stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.
    Texts without words are like no other and stay; rows with null or repeated
    ids are judged as rows of their own, null ids last."""
    return near_dedup.drop_near_duplicates(docs, shingle=SHINGLE, percent=SIMILAR)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none;
    an empty benchmark rejects nothing."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their targets. Null
    sources are one source; a null text has no words; rows with null or repeated
    ids have copies of their own, and equal rows share theirs."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it; equal rows and
    rows without an id get places of their own."""
    return sharding.shard_documents(docs, shards=SHARDS)


STAGES = [("quality classifier", good), ("near duplicates", distinct), ("decontamination", clean), ("source mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs


#: Near-duplicate groups and the classifier are not to be had in SQL; tests hold
#: the stages against brute force.
ORACLE_SQL = None
