"""A training corpus from ``documents``, in five stages; each reads all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, jaccard_join, mixing, quality, sharding
from lexloom.llm.queries import MIX, SHARDS
from lexloom.plans.scratch import shared_dir
from lexloom.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates (5-word shingles, similarity of 0.8 or more)."""
    return jaccard_join.drop_near_duplicates(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights; a source may repeat."""
    return mixing.mix(docs, **MIX).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its shard."""
    return sharding.place(docs, ["doc_id"], SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", jaccard_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", temperature_mixing),
    ("sharding", shard),
]
#: The first stage fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
