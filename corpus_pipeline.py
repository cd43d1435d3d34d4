"""Documents to training sequences in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup
from lakequill.llm.text import checkpoint_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.5, (4, 2))


def filter_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more, the one of least id stays."""
    return jaccard_join.keep_one(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier place has are cut out."""
    return suffix_dedup.without_repeats(docs, 50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; see packing.digest for the columns."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 4096))


STAGES = [("quality classifier", classify), ("quality rules", filter_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("packing", pack)]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between them the rows are written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
