"""Retrieval from end to end, and the parts of it that call out to a model: scorers and embedders over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakequill.operators.retrieval import dense_topk, down_weight, hybrid, top, written

#: Scores of the contents for a query, one each and in their order.
Scorer = Callable[[str, list[str]], list[float]]
#: Vectors of the texts, one each and in their order.
Embedder = Callable[[list[str]], list[list[float]]]


def rerank_batches(hits: DataFrame, queries: DataFrame, chunks: DataFrame, pool: int, scorer: Scorer) -> DataFrame:
    """query_id, chunk_id, rank, score, failed: the first `pool` candidates of each query (query_id, chunk_id, rank,
    score) in the order of the scorer's scores, ties by the earlier rank.

    The scorer gets a query's text with the contents of its candidates, `pool` at most. Where it raises an error or
    doesn't give a finite number for each, the query keeps its order and scores, and `failed` is true; one candidate is
    not scored. A null text or content is given as empty.
    """
    ids = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}
    some = hits.where(F.col("rank") <= pool).join(queries.select(F.col("id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")), "query_id").join(chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content")), "chunk_id")
    ordered = some.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), "text", "content").repartition("query_id").sortWithinPartitions("query_id", "rank", "chunk_id")

    def score(rows: list[dict]) -> tuple[list[float], bool]:
        old = [r["score"] for r in rows]
        if len(rows) < 2:
            return old, False
        try:
            new = [float(x) for x in scorer(rows[0]["text"], [r["content"] for r in rows])]
        except Exception:  # whatever a model's client raises
            return old, True
        return (new, False) if len(new) == len(rows) and all(abs(x) < float("inf") for x in new) else (old, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                if held and held[0]["query_id"] != r["query_id"]:
                    yield out(held, schema)
                    held = []
                held.append(r)
        if held:
            yield out(held, schema)

    def out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        scores, failed = score(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in ("query_id", "chunk_id", "rank")] + [pa.array(scores, pa.float64()), pa.array([failed] * len(rows))], ["query_id", "chunk_id", "before", "score", "failed"])

    scored = ordered.mapInArrow(run, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, before int, score double, failed boolean")
    order = [F.when(F.col("failed"), 0.0).otherwise(-F.col("score")), F.col("before"), F.col("chunk_id")]
    return top(scored, pool, *order).select("query_id", "chunk_id", "rank", "score", "failed")


def retrieve(
    queries: DataFrame, vectors: DataFrame, chunks: DataFrame, search: Callable[[DataFrame, int], DataFrame] | None = None, *,
    where: Column | None = None, dense_only_filter: bool = False, candidates: int = 30, fused: int = 30, similarity: float = 0.0,
    synthesis_weight: float = 1.0, scorer: Scorer | None = None, pool: int = 30, k: int = 5, rerank_threshold: float = 0.0,
) -> DataFrame:
    """query_id, chunk_id, rank, score: the k best chunks of each query.

    queries: id, text, embedding; vectors: id (of a chunk), embedding; chunks: chunk_id, content, file_path and what
    `where` asks for. `candidates` dense hits with a cosine of `similarity` or more are fused with as many of `search`
    (sparse; none: dense alone) to `fused`. `where` narrows the dense recall; the sparse hits too unless
    dense_only_filter. Syntheses are weighed down (0: out). With a scorer the first `pool` are scored anew, weighed again,
    cut to k, and those under rerank_threshold go; without, the first k stay. The fused hits, a few rows a query, are
    written once.
    """
    ids = chunks.where(where).select("chunk_id") if where is not None else None
    asked = vectors.join(ids.withColumnRenamed("chunk_id", "id"), "id", "left_semi") if ids is not None else vectors
    hits = dense_topk(queries, asked, candidates, similarity)
    if search:
        sparse = search(queries, candidates)
        if ids is not None and not dense_only_filter:
            sparse = top(sparse.join(ids, "chunk_id", "left_semi").drop("rank"), candidates, F.desc("score"), "chunk_id")
        hits = hybrid(hits, sparse, fused)
    hits, paths = written(hits.select("query_id", "chunk_id", "rank", "score")), chunks.select("chunk_id", "file_path")
    if synthesis_weight < 1:
        hits = down_weight(hits.join(paths, "chunk_id"), synthesis_weight).select("query_id", "chunk_id", "rank", "score")
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    hits = rerank_batches(hits, queries, chunks, pool, scorer).drop("failed")
    if synthesis_weight < 1:
        hits = down_weight(hits.join(paths, "chunk_id"), synthesis_weight).select("query_id", "chunk_id", "rank", "score")
    hits = hits.where(F.col("rank") <= k)
    return hits.where(F.col("score") >= rerank_threshold) if rerank_threshold > 0 else hits


CACHE = "key string, embedding array<double>, model string"


def cached(folder: str, rows: DataFrame) -> DataFrame:
    """key, embedding, model of the cache under folder; none where there is no cache yet."""
    spark = rows.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder)


def embedded(rows: DataFrame, text: str, model: str, embedder: Embedder, folder: str, batch: int = 100) -> DataFrame:
    """rows with `embedding`, by a cache under folder, keyed by model and the MD5 of the text.

    Only distinct texts that the cache lacks reach the embedder, `batch` at a time; their vectors are appended to the
    cache, by model, before any is used. An embedder that gives another number of vectors than it got texts is an error,
    as vectors would meet other texts; then nothing is appended. A null text has no embedding. To be run by one job
    at a time; two that embed the same text at once leave two equal rows, of which one is taken.
    """
    keyed = rows.withColumn("key", F.md5(text))
    known = cached(folder, rows).where(F.col("model") == model)
    missing = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.first(text).alias("text")).join(known, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        texts: list[str] = []

        def out() -> pa.RecordBatch:
            vectors = embedder(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([[*map(float, v)] for v in vectors], pa.list_(pa.float64()))], ["key", "embedding"])

        for part in batches:
            for key, value in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                keys.append(key)
                texts.append(value)
                if len(texts) == batch:
                    yield out()
                    keys, texts = [], []
        if texts:
            yield out()

    made = missing.mapInArrow(run, "key string, embedding array<double>").withColumn("model", F.lit(model))
    made.write.mode("append").partitionBy("model").parquet(folder)
    now = cached(folder, rows).where(F.col("model") == model).groupBy("key").agg(F.first("embedding").alias("embedding"))
    return keyed.join(now, "key", "left").drop("key")
