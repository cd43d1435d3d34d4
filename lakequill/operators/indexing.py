"""Building an index as versions of a chunk table, and adding single documents to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunks as a new version, then points to it; readers see the old version until all rows are there."""
    version = uuid.uuid4().hex
    chunks.write.parquet(f"{folder}/{version}")
    spark = chunks.sparkSession
    spark.sql("SELECT current_timestamp() AS at").withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return current(spark, folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the version that was built last."""
    last = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "at").alias("version")).first()
    return spark.read.parquet(f"{folder}/{last.version}")


def add(stored: DataFrame, new: DataFrame, overwrite: bool = False, key: str = "doc_id") -> DataFrame:
    """stored with the chunks of new documents; of documents in both, the stored chunks stay unless overwrite."""
    if overwrite:
        return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    return stored.unionByName(new.join(stored.select(key).distinct(), key, "left_anti"))
