"""A corpus pipeline: every stage is one operator of plumbline.llm over all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, jaccard, mixing, quality, sharding
from plumbline.session import checkpoint_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words to a shingle, similarity 0.8 or more."""
    return jaccard.one_per_component(docs, width=5, percent=80).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark string occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once per epoch, once more if the fraction reaches them, not at all if neither does."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    return sharding.shard_documents(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# A trained model and components of links are beyond SQL; tests hold every stage against its own definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
