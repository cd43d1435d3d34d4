import hashlib
import os
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.operators import chunking, evaluation, inverted, retrieval, retrieve, sync
from lakequill.sources import datasets, folders

CHUNK = "chunk_id long, content string, file_path string, kind string"


def by_hand(contents, query, k1=1.5, b=0.75):
    docs = {i: (c or "").lower().split() for i, c in contents.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: np.log(n - m + 0.5) - np.log(m + 0.5) for t, m in df.items()}
    floor = 0.25 * np.mean([*raw.values()])
    idf = {t: floor if w < 0 else w for t, w in raw.items()}
    scores = {i: sum(m * idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t, m in Counter(query.lower().split()).items() if t in d) for i, d in docs.items()}
    return sorted(((i, s) for i, s in scores.items() if round(s, 6) > 0), key=lambda x: (-round(x[1], 6), x[0]))


@pytest.mark.parametrize("filtered, sent", [(10_000, 200_000), (0, 0)])
def test_stored_index_equals_plain_sums(spark, tmp_path, monkeypatch, filtered, sent):
    """With terms in the scan's filter and broadcast, and with joins; some terms are nearly everywhere."""
    monkeypatch.setattr(inverted, "FILTERED", filtered)
    monkeypatch.setattr(inverted, "SENT", sent)
    monkeypatch.setattr(inverted, "FILE_ROWS", 20)  # several buckets and files a bucket
    monkeypatch.setattr(inverted, "MOST_BUCKETS", 3)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    contents = {i: " ".join(["All", *rng.choice(words, int(rng.integers(1, 12)), p=np.arange(30, 0, -1) / 465)]) for i in range(150)} | {150: None, 151: ""}
    inverted.build(spark.createDataFrame([*contents.items()], "chunk_id long, content string"), str(tmp_path / "i"))
    asked = {1: "w0 w3 w3 all", 2: "W29 nothing", 3: "", 4: "unknown"}
    rows = inverted.search(spark, str(tmp_path / "i"), spark.createDataFrame([*asked.items()], "id long, text string"), 7).collect()
    for q, text in asked.items():
        want = by_hand(contents, text)[:7]
        got = sorted((r["rank"], r.chunk_id, r.score) for r in rows if r.query_id == q)
        assert [(i, pytest.approx(s, abs=1e-5)) for i, s in want] == [(i, s) for _, i, s in got]
    plain = retrieval.bm25_search(spark.createDataFrame([*asked.items()], "id long, text string"), spark.createDataFrame([*contents.items()], "chunk_id long, content string"), 7)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in rows}


def test_scores_strip_by_strip(spark):
    """Strips of a few postings, chunks that cross them and ids that are strings."""
    rng = np.random.default_rng(8)
    contents = [(f"c{i:03}", " ".join(rng.choice(["a", "b", "c", "d", "e"], int(rng.integers(1, 9))))) for i in range(90)]
    postings, terms, totals = retrieval.bm25_index(spark.createDataFrame(contents, "chunk_id string, content string"))
    wanted = retrieval.asked_terms(spark.createDataFrame([("q1", "a b b"), ("q2", "e")], "id string, text string")).join(terms, "term")
    avgdl = totals.first().avgdl
    plain = {tuple(r) for r in retrieval.bm25_scores(wanted, postings, F.lit(avgdl), 6, 1.5, 0.75).collect()}
    for strip in (1, 7, 1000):
        scored = inverted.by_chunk(postings, wanted.select("query_id", "term", "times", "idf").collect(), avgdl, 6, 1.5, 0.75, strip)
        got = retrieval.top(scored, 6, F.desc("score"), "chunk_id").select("query_id", "chunk_id", "rank", "score").collect()
        assert {(r[0], r[1], r[2], round(r[3], 5)) for r in got} == {(a, b, c, round(d, 5)) for a, b, c, d in plain}


def test_index_of_nothing(spark, tmp_path):
    inverted.build(spark.createDataFrame([], "chunk_id long, content string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert inverted.terms(spark, str(tmp_path / "i")).count() == 0 and inverted.search(spark, str(tmp_path / "i"), asked, 3).count() == 0


def test_hits_joined_with_themselves(spark):
    """Hits that are used on both sides of a join keep all their rows, as they are written once."""
    v = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i)), 1.0]) for i in range(40)], "id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, f"t{i % 7} common", "/v/syntheses/x" if i % 5 == 0 else "/n", "a") for i in range(40)], CHUNK)
    asked = v.where("id < 12").withColumn("text", F.concat(F.lit("common t"), (F.col("id") % 7).cast("string")))
    hits = retrieve.retrieve(asked, v, chunks, lambda q, n: retrieval.bm25_search(q, chunks, n), candidates=8, fused=8, synthesis_weight=0.5, scorer=lambda q, c: [float(len(set(q.split()) & set(x.split()))) for x in c], pool=8, k=3)
    own = hits.join(chunks.select("chunk_id", "file_path"), "chunk_id")
    first = own.groupBy("query_id", "file_path").agg(F.min("rank").alias("first"))
    assert first.join(own.select("query_id", "file_path").distinct(), ["query_id", "file_path"]).count() == first.count() and hits.count() == 36


def test_filters_and_thresholds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.5, 0.5])], "id long, embedding array<double>")
    chunks = spark.createDataFrame([(1, "x a", "/n", "a"), (2, "x b", "/n", "b"), (3, "x c", "/n", "a"), (4, "y", "/v/syntheses/s", "a")], CHUNK)
    asked = spark.createDataFrame([(9, "x", [1.0, 0.0])], "id long, text string, embedding array<double>")
    sparse = lambda q, n: q.select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))).alias("chunk_id")).withColumn("rank", F.col("chunk_id").cast("int") - 1).withColumn("score", F.lit(5.0))
    run = lambda **more: [(r.chunk_id, round(r.score, 3)) for r in retrieve.retrieve(asked, v, chunks, **more).orderBy("rank").collect()]
    assert run() == [(1, 1.0), (2, 0.994), (4, 0.707), (3, 0.0)]
    assert run(similarity=0.7) == [(1, 1.0), (2, 0.994), (4, 0.707)] and run(similarity=0.7, k=1) == [(1, 1.0)]
    assert run(where=F.col("kind") == "a", similarity=0.5) == [(1, 1.0), (4, 0.707)]
    assert {i for i, _ in run(search=sparse, where=F.col("kind") == "a", dense_only_filter=True)} == {1, 2, 3, 4}
    assert {i for i, _ in run(search=sparse, where=F.col("kind") == "a")} == {1, 3, 4}
    assert run(synthesis_weight=0.0, similarity=0.5) == [(1, 1.0), (2, 0.994)] and run(synthesis_weight=0.5, similarity=0.5)[-1] == (4, 0.354)
    scorer = lambda q, c: [{"x a": 0.2, "x b": 0.9, "y": 0.8}[x] for x in c]
    assert run(similarity=0.5, scorer=scorer, rerank_threshold=0.5) == [(2, 0.9), (4, 0.8)]
    assert run(similarity=0.5, scorer=scorer, pool=2, synthesis_weight=0.5) == [(2, 0.9), (1, 0.2)]


@pytest.mark.parametrize("answer", [lambda q, c: 1 / 0, lambda q, c: [0.5], lambda q, c: [float("nan")] * len(c), lambda q, c: [None] * len(c), lambda q, c: [0.1] * (len(c) + 1)])
def test_scorers_that_fail(spark, answer):
    hits = spark.createDataFrame([(1, 10, 1, 0.3), (1, 11, 2, 0.9), (2, 10, 1, 0.4)], "query_id long, chunk_id long, rank int, score double")
    chunks = spark.createDataFrame([(10, "a"), (11, None)], "chunk_id long, content string")
    rows = retrieve.rerank_batches(hits, spark.createDataFrame([(1, "q"), (2, None)], "id long, text string"), chunks, 5, answer).collect()
    assert {(r.query_id, r.chunk_id, r["rank"], r.score, r.failed) for r in rows} == {(1, 10, 1, 0.3, True), (1, 11, 2, 0.9, True), (2, 10, 1, 0.4, False)}


def test_embedding_cache(spark, tmp_path):
    calls, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    os.mkdir(calls)

    def embed(texts):
        for t in texts:  # a file for each text that is computed
            open(f"{calls}/{t}-{time.time_ns()}", "w").close()
        assert len(texts) <= 3
        return [[float(len(t))] for t in texts]

    def run(*texts, model="m"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        got = retrieve.embedded(rows, "text", model, embed, cache, 3)
        return {r.i: r.embedding for r in got.collect()}, sorted(x.split("-")[0] for x in os.listdir(calls))

    assert run("a", "bb", "a", None) == ({0: [1.0], 1: [2.0], 2: [1.0], 3: None}, ["a", "bb"])
    assert run("a", "bb", "ccc") == ({0: [1.0], 1: [2.0], 2: [3.0]}, ["a", "bb", "ccc"])
    assert run("ccc", "a") == ({0: [3.0], 1: [1.0]}, ["a", "bb", "ccc"])  # nothing is computed
    assert run("a", model="n")[1] == ["a", "a", "bb", "ccc"] and run()[0] == {}
    many = spark.range(50).select(F.col("id").cast("string").alias("text"))
    with pytest.raises(Exception, match="gave 1 vectors for 3 texts"):
        retrieve.embedded(many, "text", "m", lambda texts: [[0.0]], cache, 3)
    assert retrieve.cached(cache, many).where("model = 'm'").count() == 3


def test_sync_scan(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("a.md", ".dot.md", "b/c.TXT", "b/d.pdf", "wiki/e.md", ".git/f.md", "b/x/y/z/deep.md", "b/node_modules/g.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (tmp_path / "outside.md").write_text("out")
    (root / "link.md").symlink_to(tmp_path / "outside.md")
    (root / "twin.md").symlink_to(root / "a.md")
    (root / "loop").symlink_to(root)
    (root / "broken.md").symlink_to(root / "nowhere")
    for depth in (0, 1, 4):
        rows = {os.path.relpath(r.path, tmp_path): r for r in folders.sync_scan(spark, str(root), depth=depth).collect()}
        assert set(rows) == {"root/a.md", "root/.dot.md", "root/b/c.TXT", "root/b/x/y/z/deep.md", "outside.md"}
    assert rows["outside.md"].size == 3 and rows["root/a.md"].hash == hashlib.md5(b"a.md").hexdigest()
    assert folders.sync_scan(spark, str(root), hashed=False).where("hash is not null").count() == 0


def test_sections_and_caps_of_long_documents(spark):
    """A document of 100,000 headings and a group of 300,000 rows take no longer a row than others."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.repeat(F.lit("#"), (1 + i % 6).cast("int")), F.lit(" h"), i.cast("string"), F.lit("\nbody"))), "\n")
    began = time.time()
    rows = chunking.sections(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("content")))
    last = rows.where("section = 99999").first()
    assert last.heading == "h100000" and last.start_line == 199_999 and last.heading_path.endswith("h99999 > h100000") and last.heading_path.count(" > ") <= 5
    kept = chunking.payload_cap(spark.range(300_000).selectExpr("1 as g", "id as pos", "id % 3 as size"), "g", "pos", "size", 1000)
    assert kept.agg(F.sum(F.when(F.col("kept"), F.col("size")))).first()[0] == 1000 and kept.count() == 300_000
    assert time.time() - began < 120
    odd = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 4), (1, 3, 1), (None, 0, 9), (None, 1, 1)], "g long, pos long, size long")
    assert {(r.g, r.pos): r.kept for r in chunking.payload_cap(odd, "g", "pos", "size", 9).collect()} == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): False, (None, 0): True, (None, 1): False}


def test_sync_outcomes(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    changes = spark.createDataFrame([("a", "added"), ("b", "added"), ("c", "added"), ("d", "updated"), ("e", "updated"), ("f", "removed"), ("g", "touched"), ("h", "unchanged")], "path string, state string")
    done = sync.outcomes(changes, paths("b", "e", "e"), paths("c", "d", "h"))
    assert tuple(sync.outcome_stats(done).first()) == (1, 1, 1, 2, 3)
    old, new = paths("c", "d", "e", "f", "g", "h").withColumn("v", F.lit("old")), paths("a", "b", "c", "d", "e").withColumn("v", F.lit("new"))
    assert {tuple(r) for r in sync.next_chunks(old, new, done).collect()} == {("a", "new"), ("c", "old"), ("d", "new"), ("e", "old"), ("g", "old"), ("h", "old")}


def test_exports_are_read_whole(spark, tmp_path):
    rows = spark.range(5).toDF("id")
    datasets.export({"chunks": rows, "none": rows.limit(0)}, str(tmp_path / "x"))
    tables = datasets.read_export(spark, str(tmp_path / "x"))
    assert {k: t.count() for k, t in tables.items()} == {"chunks": 5, "none": 0}
    rows.write.mode("append").parquet(str(tmp_path / "x" / "chunks"))
    with pytest.raises(ValueError, match="chunks has 10 rows"):
        datasets.read_export(spark, str(tmp_path / "x"))


def test_details_with_failures(spark):
    details = spark.createDataFrame([(1, "7", 1, [0.5], 10), (2, "8", None, [0.1], 31), (3, None, None, None, 0)], "query_id long, docs string, first_hit int, scores array<double>, context_tokens long")
    took = spark.createDataFrame([(1, None, 1.25), (2, "timeout", 9.0)], "query_id long, error string, latency_ms double")
    done = evaluation.with_outcomes(details, took)
    assert {r.query_id: (r.docs, r.context_tokens, r.error) for r in done.collect()} == {1: ("7", 10, None), 2: (None, 0, "timeout"), 3: (None, 0, None)}
    assert tuple(evaluation.details_summary(done).first()) == (3, 1, 5.0, 1.3)


def test_flattened_metadata(spark):
    raw = ['{"a": "x", "b": 1.5, "c": null, "d": {"e": [1]}, "f": false}', "{}"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", sync.flattened(F.parse_json("raw")).alias("m"))
    assert {r.i: r.m for r in rows.collect()} == {0: {"a": "x", "b": "1.5", "c": "", "d": '{"e":[1]}', "f": "false"}, 1: {}}
