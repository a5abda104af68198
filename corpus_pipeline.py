"""From raw documents to shards: stages of the training-data operators, each read from what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import read, stage
from repochron.llm.decontaminate import clean_documents
from repochron.llm.jaccard_join import one_of_each
from repochron.llm.mixing import mix_documents
from repochron.llm.quality_model import score_quality
from repochron.llm.sharding import shard_documents

#: share of the tokens that each domain is to have; ``mix`` takes plain text at least once
MIX = {"plain": 0.985, "low": 0.01, "toxic": 0.005}
SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones."""
    return score_quality(docs, read(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return one_of_each(docs, shingle=5, num=80, den=100)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, plain ones once at least."""
    taken = mix_documents(docs, read(spark, sf_dir, "labels"), MIX, kept="plain")
    return taken.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, shard, slot) of every row that is left."""
    return shard_documents(docs, SHARDS).select("doc_id", "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_uncontaminated), ("mixing", mix), ("sharding", shard)]

#: a trained network and a greedy partition are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
