"""A BM25 index on disk: built once, then searched for any number of query tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from lakequill.operators.retrieval import asked_terms, bm25_scores, postings_of, raw_weight, top

#: Postings that a file holds, about, and the most buckets (folders that terms are dealt to by hash).
FILE_ROWS, MOST_BUCKETS = 250_000, 256
#: Up to so many asked terms are written into the scan's filter, up to so many pairs of query and term go out with tasks.
FILTERED, SENT = 10_000, 200_000


def build(chunks: DataFrame, folder: str) -> None:
    """Writes under folder: `postings` (bucket, term, chunk_id, tf, dl), `terms` (bucket, term, n, idf) and `totals` (one
    row: chunks, avgdl, buckets). chunks: chunk_id, content; null content has no tokens.

    Buckets are folders, so that a search reads those of its terms alone; files are sorted by term, so that their
    statistics leave out most of the rest. A bucket's postings are dealt to several files by chunk, so that a term that
    most chunks have is written and read by many tasks.
    """
    size = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")).first()
    files = 1 + size.chars // (6 * FILE_ROWS)
    buckets = min(files, MOST_BUCKETS)
    slices = -(-files // buckets)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    dealt = postings_of(chunks).withColumn("bucket", bucket).repartition(int(buckets * slices), "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)))
    dealt.sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    spark = chunks.sparkSession
    postings = spark.read.schema(dealt.schema).parquet(f"{folder}/postings")
    counts = postings.groupBy("bucket", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).withColumn("raw", raw_weight(F.lit(size.chunks)))
    counts.sortWithinPartitions("bucket", "term").write.parquet(f"{folder}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    sums = counts.agg(F.avg("raw").alias("mean"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
    idf = F.when(F.col("raw") < 0, F.lit(0.25 * (sums.mean or 0.0))).otherwise(F.col("raw"))
    counts.select("bucket", "term", "n", idf.alias("idf")).write.partitionBy("bucket").parquet(f"{folder}/terms")
    spark.createDataFrame([(size.chunks, sums.tokens / max(1, size.chunks), int(buckets))], "chunks long, avgdl double, buckets int").coalesce(1).write.parquet(f"{folder}/totals")


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/{name}")


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """term, n, idf of an index."""
    return table(spark, folder, "terms", "term string, n long, idf double").drop("bucket")


def by_chunk(postings: DataFrame, wanted: list[Row], avgdl: float, k: int, k1: float, b: float, strip: int = 1_000_000) -> DataFrame:
    """query_id, chunk_id, score: of each task the k best chunks of each query. Postings are shuffled once, by chunk and
    with a number for the term,
    whatever the number of queries that want a term; a task scores about `strip` postings of whole chunks at a time."""
    kind = postings.schema["chunk_id"].dataType.simpleString()
    terms = sorted({r.term for r in wanted})
    code = {t: i for i, t in enumerate(terms)}
    asked: dict = {}
    for r in wanted:
        asked.setdefault(r.query_id, []).append((code[r.term], r.times * r.idf))
    queries = {q: (np.array([c for c, _ in x]), np.array([w for _, w in x])) for q, x in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        held: list[pa.RecordBatch] = []
        size = 0

        def score(table: pa.Table) -> None:
            found = table["code"].to_numpy()
            tf, dl = table["tf"].to_numpy().astype(float), table["dl"].to_numpy()
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            chunk = table["chunk_id"].combine_chunks().dictionary_encode()
            ids, at = np.array(chunk.dictionary.to_pylist(), object), chunk.indices.to_numpy()
            order = np.argsort(found, kind="stable")
            begin = np.searchsorted(found[order], np.arange(len(terms) + 1))
            at, weight = at[order], weight[order]
            for q, (codes, times) in queries.items():
                n = begin[codes + 1] - begin[codes]
                if not n.sum():
                    continue
                rows = np.repeat(begin[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
                scores = np.round(np.bincount(at[rows], weight[rows] * np.repeat(times, n), len(ids)), 6)
                some = np.flatnonzero(scores > 0)
                if len(some) > k:
                    least = np.partition(scores[some], -k)[-k]
                    some = some[scores[some] >= least]
                every = best.get(q, []) + [*zip((-scores[some]).tolist(), ids[some].tolist(), strict=True)]
                best[q] = sorted(every)[:k]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= strip:
                table = pa.Table.from_batches(held)
                ids = table["chunk_id"]
                whole = table.num_rows
                while whole and ids[whole - 1] == ids[table.num_rows - 1]:  # the last chunk may go on
                    whole -= 1
                if whole:
                    score(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), table.num_rows - whole
        if size:
            score(pa.Table.from_batches(held))
        out = [(q, i, -s) for q, x in best.items() for s, i in x]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array([x[0] for x in out], id_type), "chunk_id": pa.array([x[1] for x in out], chunk_type), "score": pa.array([x[2] for x in out], pa.float64())})

    chunk_type = to_arrow_type(postings.schema["chunk_id"].dataType)
    id_type = pa.array([wanted[0].query_id]).type if wanted else pa.int64()
    query_kind = from_arrow_type(id_type).simpleString()
    coded = postings.join(F.broadcast(postings.sparkSession.createDataFrame([*code.items()], "term string, code int")), "term").select("chunk_id", "dl", "code", "tf")
    return coded.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, f"query_id {query_kind}, chunk_id {kind}, score double")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, rank, score: the k best chunks of each query (id, text) by BM25, of which those above 0 stay.

    The queries' distinct terms are counted first: up to FILTERED of them the scans of postings and terms are filtered
    by bucket and term, beyond that they are joined. Up to SENT pairs of query and term go out with the tasks, which
    score whole chunks; beyond that pairs and postings are joined, and a term that many chunks have is split by Spark's
    skew join.
    """
    totals = spark.read.parquet(f"{folder}/totals").first()
    asked = asked_terms(queries)
    pairs = asked.agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms")).first()
    bucket = F.pmod(F.xxhash64("term"), F.lit(totals.buckets)).cast("int")
    kind = dict(spark.read.parquet(f"{folder}/postings").dtypes)["chunk_id"] if totals.avgdl else "long"
    postings, weights = table(spark, folder, "postings", f"chunk_id {kind}, dl long, term string, tf long"), table(spark, folder, "terms", "term string, n long, idf double")
    if pairs.terms <= FILTERED:
        wanted = asked.select("term", bucket.alias("bucket")).distinct().collect()
        some = F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("term").isin(sorted(r.term for r in wanted))
        postings, weights = postings.where(some), weights.where(some)
    wanted = asked.join(weights.select("term", "idf"), "term")
    if pairs.n > SENT or not totals.avgdl:
        return bm25_scores(wanted, postings.drop("bucket"), F.lit(totals.avgdl), k, k1, b)
    scored = by_chunk(postings.select("chunk_id", "dl", "term", "tf"), wanted.select("query_id", "term", "times", "idf").collect(), totals.avgdl, k, k1, b)
    return top(scored, k, F.desc("score"), "chunk_id").select("query_id", "chunk_id", "rank", "score")
