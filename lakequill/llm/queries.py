"""One query for each operator of this subpackage, with production parameters, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakequill.llm import byte_bpe, conversation_repair, jaccard_join, language_id, lm_scoring, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup, topk_search, toxicity, url_filters
from lakequill.llm.text import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, 4096))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), 50).select("doc_id", "start", "stop", "later", "twin")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), (7, 2))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), (4, 2))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.labelled(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predict(table(spark, sf_dir, "documents"), (4, 2))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_tails(table(spark, sf_dir, "documents"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), (4, 2))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(*conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations"))))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
m AS (
    SELECT doc_id, words, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
        length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, i, hash(words[i:i+7]) AS h FROM m, LATERAL (SELECT unnest(range(1, n_words - 6)) AS i)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM w) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, LATERAL (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
f AS (SELECT m.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 15 * word_chars OR 100 * n_upper > 40 * (n_upper + n_lower) OR 100 * n_bars > 15 * n_words OR 100 * n_bangs > 15 * n_words OR 100 * len(list_filter(words[2:], lambda w, i: w = words[i])) > 20 * n_words OR 100 * n_dup_lines > 40 * len(lines)) AS kept
FROM f
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(words[i:i+3]) AS h FROM d, LATERAL (SELECT unnest(range(1, greatest(len(words) - 2, 2))) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

def conversation_sql() -> str:
    """The same programme as a recursive query, which carries cost, edits and repaired text for each of the four places."""
    far = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"

    def go(s: str, cost: int | str, letter: str, out: str = "''") -> str:
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {out}}}"

    def best(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def when(test: str, then: str) -> str:
        return f"CASE WHEN {test} THEN {then} ELSE {far} END"

    extra, stays = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    line = "chr(10) || role || ':' || text"
    as_ = lambda role: f"chr(10) || '{role}:' || text"
    keep = lambda s, own: when(f"{stays} AND starts_with(role, '{own}')", go(s, extra, "K", line))
    rerole = lambda s, role: when(stays, go(s, f"1 + {extra}", "R", as_(role)))
    step = {
        0: best(go("s0", 2, "D")),
        1: best(go("s1", 2, "D"), keep("s0", "s")),
        2: best(go("s2", 2, "D"), *[f(s, own) for s in ("s0", "s1", "s3") for f, own in ((keep, "u"), (rerole, "user"))]),
        3: best(go("s3", 2, "D"), keep("s2", "a"), rerole("s2", "assistant")),
    }
    user = best("s2", *[go(s, 5, "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
    assistant = best("s3", go("s2", 5, "I", "chr(10) || 'assistant:'"))
    first = f"(SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM known)"
    inserted = lambda rows: f"SELECT k, i, s0, s1, s2, {assistant} AS s3 FROM (SELECT k, i, s0, s1, {user} AS s2, s3 FROM {rows})"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS k,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate FROM conversations, crc),
known AS (SELECT DISTINCT k, conv_id FROM c),
d AS (SELECT k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY k ORDER BY i) AS before FROM o),
dp AS ({inserted(first)} UNION ALL {inserted(f'(SELECT r.k, r.i, {step[0]} AS s0, {step[1]} AS s1, {step[2]} AS s2, {step[3]} AS s3 FROM dp JOIN r ON r.k = dp.k AND r.i = dp.i + 1)')}),
e AS (SELECT k, {best('s0', 's3')} AS s FROM (SELECT k, arg_max(s0, i) AS s0, arg_max(s3, i) AS s3 FROM dp GROUP BY k)),
f AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, s.c AS cost, s.a AS audit, sha256(substr(s.o, 2)) AS repaired_sha256
FROM known LEFT JOIN f USING (k) JOIN e USING (k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_quality_rules, op4_byte_bpe, op5_jaccard_join, op6_topk_search, op7_lm_scoring, op8_quality_classifier, op9_url_filters, op10_language_id, op11_periodic_runs, op12_toxicity, op13_conversation_repair)}
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op6_topk_search": OP6_SQL, "op13_conversation_repair": conversation_sql()}
