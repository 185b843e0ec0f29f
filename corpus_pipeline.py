"""A corpus pipeline: toxic documents go, poor ones go, one of each group of near duplicates stays, the rest is packed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, packing, quality, toxicity
from tessera.llm.common import trim
from tessera.llm.queries import vocabulary
from tessera.session import ship

#: SQL has no form of the trained stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger, trained on their labels, scores under one half."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    trim()  # the driver held the words it learnt from
    return toxicity.clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the isolation forest keep."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.passed(docs, quality.fit(docs, labels))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id."""
    ship(spark)
    return jaccard.first_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces."""
    ship(spark)
    return packing.packed(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near duplicates", drop_near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet to the shared folder and read again."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessera-pipeline-")
    base = f"{base}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
