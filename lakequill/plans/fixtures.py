"""Tables that queries derive from the given ones, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakequill.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a chunk; five lines are a section."""
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "/v/syntheses/").otherwise("/v/notes/"), F.col("doc_id").cast("string"))
    return lines(spark, sf_dir).select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_id"), "doc_id", F.col("pos").alias("chunk_index"), F.concat(F.lit("H"), F.floor(F.col("pos") / 5).cast("string")).alias("heading_path"), F.col("line").alias("content"), path.alias("file_path"), F.col("pos").alias("start_line"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings of several levels, fences and blank lines put in by line number."""
    i = F.col("pos") % 12
    n = F.col("pos").cast("string")
    part = F.when(i == 0, F.concat(F.lit("# H"), n, F.lit("\n\n"), F.col("line"))).when(i == 4, F.concat(F.lit("## S"), n, F.lit("\n\n"), F.col("line"))).when(i == 7, F.concat(F.lit("#### D"), n, F.lit("\n\n"), F.col("line"))).when(i == 8, F.concat(F.lit("### E"), n, F.lit("\n\n"), F.col("line"))).when(i == 10, F.concat(F.lit("```\n# not a heading\n"), F.col("line"), F.lit("\n```"))).otherwise(F.col("line"))
    rows = lines(spark, sf_dir).withColumn("part", part).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (vec_id divisible by 20) and corpus (every row): id, embedding, label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v.where("id % 20 = 0"), v


def token_vectors(rows: DataFrame, text: str) -> DataFrame:
    """embedding: how many of a text's tokens have each first hex digit of their md5, in place of a model's vectors."""
    digits = F.array_join(F.transform(tokens(F.col(text)), lambda t: F.substring(F.md5(t), 1, 1)), "")
    counts = lambda x: F.array(*[(F.length(x) - F.length(F.replace(x, F.lit(h)))).cast("double") for h in "0123456789abcdef"])
    return rows.withColumn("embedding", F.transform(F.array(digits), counts)[0])  # the digits, bound once for all counts


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files and manifest (path, mtime, size, hash) that differ in the ways a sync meets."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/v/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1000).cast("long").alias("mtime"), F.length("text").cast("long").alias("size"), F.md5("text").alias("hash"))
    m = d.withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, 999).otherwise(F.col("mtime")).cast("long")).withColumn("hash", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("hash")))
    return d.where("doc_id % 11 <> 0").drop("doc_id"), m.where("doc_id % 13 <> 0").drop("doc_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"))


def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, misread by rule; each character beyond ASCII is a question mark (DuckDB's levenshtein counts bytes).
    Dealt over all cores first, as lines differ much in length."""
    ref = F.regexp_replace("line", r"[^\x00-\x7F]", "?")
    got = F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), ref)).when(F.col("doc_id") % 2 == 0, F.replace(ref, F.lit("e"), F.lit("c"))).otherwise(ref)
    return lines(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism).select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), ref.alias("reference"), got.alias("got"))


LINES = "lines AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
CHUNKS = LINES + """,
chunks AS (SELECT doc_id * 100000 + pos AS chunk_id, doc_id, pos AS chunk_index, 'H' || (pos // 5) AS heading_path, line AS content, pos AS start_line,
    CASE WHEN doc_id % 10 = 0 THEN '/v/syntheses/' ELSE '/v/notes/' END || doc_id AS file_path FROM lines)"""
MARKDOWN = LINES + """,
markdown AS (SELECT doc_id, string_agg(CASE pos % 12 WHEN 0 THEN '# H' || pos || chr(10) || chr(10) || line WHEN 4 THEN '## S' || pos || chr(10) || chr(10) || line WHEN 7 THEN '#### D' || pos || chr(10) || chr(10) || line
    WHEN 8 THEN '### E' || pos || chr(10) || chr(10) || line WHEN 10 THEN '```' || chr(10) || '# not a heading' || chr(10) || line || chr(10) || '```' ELSE line END, chr(10) || chr(10) ORDER BY pos) AS content FROM lines GROUP BY doc_id)"""
DENSE = """dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS want, c.label AS label,
    round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 10)"""
BM25 = CHUNKS + r""",
toks AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM chunks),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
tot AS (SELECT count(*) AS chunks, avg(len(t)) AS avgdl FROM toks),
raw AS (SELECT term, ln(chunks - n + 0.5) - ln(n + 0.5) AS raw, n FROM (SELECT term, count(*) AS n FROM post GROUP BY term), tot),
terms AS (SELECT term, n, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10 AND score > 0)"""
TOKEN_DENSE = r"""digits AS (SELECT true AS asked, item_id AS id, text FROM benchmark UNION ALL SELECT false, chunk_id, content FROM chunks),
counted AS (SELECT asked, id, list_transform(string_split('0123456789abcdef', ''), lambda h: (length(s) - length(replace(s, h, '')))::DOUBLE) AS v FROM (SELECT asked, id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: substr(md5(t), 1, 1)), '') AS s FROM digits) WHERE length(s) > 0),
second AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.id AS query_id, c.id AS chunk_id, round(greatest(0, least(1, list_cosine_similarity(q.v, c.v))), 6) AS score FROM counted q JOIN counted c ON q.asked AND NOT c.asked)) WHERE rank <= 10)"""
