"""Retrieval evaluation over hits (query_id, rank, chunk_id, doc_id, score) and gold (query_id, doc_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakequill.functions.text import char_error_rate, context_tokens


def ranked_docs(hits: DataFrame, k: int) -> DataFrame:
    """Documents of the first k chunks at their first rank."""
    return hits.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))


def per_query(queries: DataFrame, hits: DataFrame, gold: DataFrame, k: int, gold_chunks: DataFrame | None = None, gold_docs: DataFrame | None = None) -> DataFrame:
    """All metrics of each query (id); queries without hits or gold have zeros, unknown chunk totals null.

    gold_chunks: query_id, total (chunks of the gold documents). gold_docs: query_id, wanted (how many gold documents
    there are), where gold lists only those that were hit."""
    marked = hits.where(F.col("rank") <= k).join(gold.select("query_id", "doc_id", F.lit(1).alias("gold")), ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    got = marked.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("gold") == 1, F.col("doc_id"))).alias("found"), F.count_distinct("doc_id").alias("docs"), F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first"), F.sum("gold").alias("chunks"), F.count("*").alias("rows")
    )
    wanted = gold_docs if gold_docs is not None else gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("wanted"))
    totals = gold_chunks if gold_chunks is not None else gold.limit(0).select("query_id", F.lit(0).alias("total"))
    every = queries.select(F.col("id").alias("query_id")).join(got, "query_id", "left").join(wanted, "query_id", "left").join(totals, "query_id", "left")
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return every.select(
        "query_id", ratio("found", "wanted").alias("doc_recall"), ratio("found", "docs").alias("doc_precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("doc_mrr"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("doc_hit"), ratio("chunks", "rows").alias("chunk_precision"), F.round(F.coalesce("chunks", F.lit(0)) / F.nullif(F.col("total"), F.lit(0)), 6).alias("chunk_recall"), F.col("first").alias("first_hit"),
    )


METRICS = ("doc_recall", "doc_precision", "doc_mrr", "doc_hit", "chunk_precision")


def macro_average(metrics: DataFrame) -> DataFrame:
    """One row: means over queries (0 for none); chunk_recall over the queries where it is known."""
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS], F.round(F.avg("chunk_recall"), 6).alias("chunk_recall"))


def long_form(averages: DataFrame) -> DataFrame:
    """metric, value."""
    return averages.select(F.explode(F.create_map(*[x for m in (*METRICS, "chunk_recall") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


def baseline_diff(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value, base, diff of metrics that both have."""
    return now.join(baseline.select("metric", F.col("value").alias("base")), "metric").where("value is not null and base is not null").withColumn("diff", F.round(F.col("value") - F.col("base"), 6))


def baseline_report(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """baseline_diff() with `error`; where the two have no metric in common, one row that says so."""
    diff = baseline_diff(now, baseline).withColumn("error", F.lit(None).cast("string"))
    shared = now.join(baseline.select("metric"), "metric", "left_semi").agg(F.count("*").alias("shared"))
    row = shared.where("shared = 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in diff.schema.fields[:-1]], F.lit("no metric in common with the baseline").alias("error"))
    return diff.unionByName(row)


def judge_summary(scores: DataFrame, by: str) -> DataFrame:
    """Mean of the valid scores (not -1), how many were valid, how many not."""
    return scores.groupBy(by).agg(F.round(F.avg(F.nullif(F.col("score"), F.lit(-1.0))), 6).alias("mean_score"), F.count_if(F.col("score") >= 0).alias("valid"), F.count_if(F.col("score") < 0).alias("errors"))


def ocr_report(pairs: DataFrame, normal: Column, normal_got: Column) -> DataFrame:
    """id, ok and error rates of (id, reference, got) raw and normalised; null where recognition failed."""
    ok = F.length(F.coalesce("got", F.lit(""))) > 0
    when = lambda c: F.when(ok, c)
    return pairs.select(
        "id", ok.alias("ok"), F.length("reference").alias("reference_len"), F.length(F.coalesce("got", F.lit(""))).alias("got_len"), F.round(when(char_error_rate(F.col("reference"), F.col("got"))), 6).alias("cer"),
        F.round(when(char_error_rate(normal, normal_got)), 6).alias("cer_normal"), when(F.col("reference") == F.col("got")).alias("exact"), when(normal == normal_got).alias("exact_normal"),
    )


def ocr_summary(report: DataFrame) -> DataFrame:
    """Totals and means over the samples that succeeded; null without any."""
    rate = lambda c: F.round(F.count_if(c) / F.nullif(F.count_if("ok"), F.lit(0)), 6)
    return report.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.round(F.count_if("ok") / F.nullif(F.count("*"), F.lit(0)), 6).alias("success_rate"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.avg("cer_normal"), 6).alias("mean_cer_normal"), rate(F.col("exact")).alias("exact_rate"), rate(F.col("exact_normal")).alias("exact_normal_rate"))


def details(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Ranked documents of each query, joined by commas."""
    docs = ranked_docs(hits, k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",").alias("docs"))
    return queries.select(F.col("id").alias("query_id")).join(docs, "query_id", "left")


def full_details(queries: DataFrame, hits: DataFrame, gold: DataFrame, contexts: DataFrame, k: int) -> DataFrame:
    """details() with first_hit (the place of the first right document in the list, null for none), scores of the
    first k hits in order, and context_tokens (0 without a context). gold: query_id, doc_id; contexts: query_id, context."""
    marked = ranked_docs(hits, k).join(gold.select("query_id", "doc_id", F.lit(True).alias("right")).distinct(), ["query_id", "doc_id"], "left")
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    first = placed.groupBy("query_id").agg(F.min(F.when(F.col("right"), F.col("place"))).alias("first_hit"))
    score = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.bround("score", 4).alias("score")))), lambda s: s["score"])
    scores = hits.where(F.col("rank") <= k).groupBy("query_id").agg(score.alias("scores"))
    used = contexts.select("query_id", context_tokens(F.col("context")).alias("context_tokens"))
    out = details(queries, hits, k).join(first, "query_id", "left").join(scores, "query_id", "left").join(used, "query_id", "left")
    return out.fillna(0, ["context_tokens"])



def ablation(configs: dict[str, DataFrame], gold: DataFrame, k: int) -> DataFrame:
    """config, queries, hits and precision at k of each configuration's hits (query_id, doc_id, rank); gold: query_id, doc_id."""
    every = reduce(DataFrame.union, [h.where(F.col("rank") <= k).select(F.lit(name).alias("config"), "query_id", "doc_id") for name, h in configs.items()])
    marked = every.join(gold.select("query_id", "doc_id", F.lit(1).alias("right")).distinct(), ["query_id", "doc_id"], "left")
    each = marked.groupBy("config", "query_id").agg(F.count("*").alias("n"), F.count("right").alias("right"))
    return each.groupBy("config").agg(F.count("*").alias("queries"), F.sum("n").alias("hits"), F.round(F.avg(F.col("right") / F.col("n")), 6).alias("precision"))


def with_outcomes(details: DataFrame, outcomes: DataFrame) -> DataFrame:
    """full_details() with error and latency_ms (one digit) from outcomes (query_id, error, latency_ms). A query that
    failed has no documents, hits or scores, and a context of no tokens; one without an outcome has neither."""
    both = details.join(outcomes.select("query_id", "error", F.round("latency_ms", 1).alias("latency_ms")), "query_id", "left")
    none = F.col("error").isNotNull()
    kept = {c: F.when(~none, F.col(c)) for c in ("docs", "first_hit", "scores")}
    return both.withColumns(kept | {"context_tokens": F.when(none, 0).otherwise(F.col("context_tokens"))})


def details_summary(details: DataFrame) -> DataFrame:
    """queries, failed, and over those that didn't fail the mean of context tokens and of latency, to one digit."""
    ok = F.col("error").isNull()
    return details.agg(F.count("*").alias("queries"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("context_tokens"))), 1).alias("context_tokens_mean"), F.round(F.avg(F.when(ok, F.col("latency_ms"))), 1).alias("latency_ms_mean"))
