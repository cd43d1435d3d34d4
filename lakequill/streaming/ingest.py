"""Continuous ingest: a stream of files keeps a table of chunks in step, each file's chunks replaced when it changes.

Under one folder lie `chunks` (what the chunker gives, and its version) and `manifest` (an entry a change, with the version
of the path's chunks), both written by appending a folder for each micro-batch. A batch's chunks are all there before its manifest, and
readers take of each path the version that the manifest names last, so that they never see half a batch. A batch that
runs again after a failure replaces its own folders; a file that comes again unchanged writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakequill.operators.sync import diff

MANIFEST = "path string, version long, chunks long, mtime long, size long, hash string, gone boolean"
ENTRY = ("path", "mtime", "size", "hash")
#: Versions between two batches of the stream, of which sweeps take the next one each.
STRIDE = 1 << 20


def log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """All entries of the manifest, those of versions from `before` on left out."""
    try:
        rows = spark.read.schema(MANIFEST + ", batch long").parquet(f"{folder}/manifest").drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows if before is None else rows.where(F.col("version") < before)


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """path, chunks, mtime, size and hash of each file as it is stored now; files that went are left out."""
    entry = F.max_by(F.struct("chunks", "mtime", "size", "hash", "gone"), "version").alias("e")
    return log(spark, folder, before).groupBy("path").agg(entry).select("path", "e.*").where("not gone").drop("gone")


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The chunks of the files as they are stored now; schema: of the chunker's columns."""
    chunks = spark.read.schema(f"{schema}, version long, batch long").parquet(f"{folder}/chunks").drop("batch")
    return chunks.join(manifest(spark, folder).select("path", F.col("chunks").alias("version")), ["path", "version"], "left_semi").drop("version")


def apply(files: DataFrame, version: int, folder: str, chunked: Callable[[DataFrame], DataFrame]) -> None:
    """One batch of files (path, mtime, text). Of a path that comes more than once the latest row counts. Added and
    updated files get new chunks; touched ones a new manifest entry alone, with the version of their chunks; a file
    without text (it couldn't be read) keeps its old chunks and entry, or stays unknown, so that it is tried again."""
    spark = files.sparkSession
    named = files.where("path is not null and text is not null").select("path", F.col("mtime").cast("long").alias("mtime"), F.length("text").cast("long").alias("size"), F.md5("text").alias("hash"), "text")
    latest = named.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "hash", "text"), F.struct("mtime", "hash")).alias("f")).select("path", "f.*").persist()
    known = manifest(spark, folder, version)
    changes = diff(latest.select(*ENTRY), known.select(*ENTRY)).where("state in ('added', 'updated', 'touched')")
    changes = changes.join(known.select("path", F.col("chunks").alias("old")), "path", "left")
    new = latest.join(changes.where("state <> 'touched'"), "path", "left_semi").select("path", "text")
    chunked(new).withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{folder}/chunks/batch={version}")
    chunks = F.when(F.col("state") == "touched", F.col("old")).otherwise(F.lit(version)).cast("long").alias("chunks")
    entries = latest.drop("text").join(changes, "path").select("path", F.lit(version).cast("long").alias("version"), chunks, "mtime", "size", "hash", F.lit(False).alias("gone"))
    entries.write.mode("overwrite").parquet(f"{folder}/manifest/batch={version}")
    latest.unpersist()


def ingest(source: DataFrame, chunked: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Runs what a stream of files (path, mtime, text) holds now through `apply`, batch by batch; a later call goes on
    from there. chunked: from (path, text) to rows with path; it sees each changed file once."""
    query = source.writeStream.foreachBatch(lambda rows, n: apply(rows, STRIDE * n, folder, chunked)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def sweep(there: DataFrame, folder: str) -> None:
    """Files of the manifest that `there` (path), a listing of all files, lacks are marked as gone; a file source alone
    can't see that. To be run between calls of ingest."""
    spark = there.sparkSession
    version = (log(spark, folder).agg(F.max("version").alias("v")).first().v or 0) + 1
    gone = manifest(spark, folder).join(there.select("path"), "path", "left_anti")
    gone.select("path", F.lit(version).cast("long").alias("version"), "chunks", "mtime", "size", "hash", F.lit(True).alias("gone")).write.mode("overwrite").parquet(f"{folder}/manifest/batch={version}")
