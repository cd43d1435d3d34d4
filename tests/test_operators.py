import datetime

import pytest
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import chunking, evaluation, indexing, retrieval, sessions, sync
from lakequill.sources import datasets, files, html
from lakequill.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_judge_score(spark):
    cases = {"SCORE: 0.8": 0.8, "SCORE：85": 0.85, "I say 7 of 10, so 0.7": 0.7, "none": -1.0, "SCORE: 250": -1.0}
    assert {k: one(spark, k, T.judge_score) for k in cases} == cases


def test_public_urls(spark):
    bad = ["ftp://a.com", "http://localhost/x", "http://127.0.0.1", "http://10.1.2.3/", "http://192.168.0.1", "http://172.20.0.1", "http://169.254.1.1", "http://0.0.0.0", "http://[::1]/", "nothing"]
    assert not any(one(spark, u, T.public_url) for u in bad)
    assert one(spark, "https://8.8.8.8/x", T.public_url) and one(spark, "https://example.org", T.public_url)


def test_tokens_of_han_runs(spark):
    assert one(spark, "Hello 检索系统", T.tokens) == ["hello", "检索", "索系", "系统"]
    assert one(spark, None, T.tokens) == []


def test_sections_nest_by_stack(spark):
    text = "# a\nx\n#### b\ny\n### c\nz\n## d\n```\n# no\n```\nw"
    rows = chunking.sections(spark.createDataFrame([(1, text)], "doc_id long, content string")).orderBy("section").collect()
    assert [r.heading_path for r in rows] == ["a", "a > b", "a > b > c", "a > d"]
    assert rows[3].content == "# no\nw" and (rows[3].start_line, rows[3].end_line) == (7, 11)


def test_packed_carries_overlap(spark):
    parts = one(spark, "\n\n".join(c * 40 for c in "abc"), lambda c: chunking.packed(c, 90, 10))
    assert parts[0] == "a" * 40 + "\n\n" + "b" * 40 and parts[1].startswith("b" * 8) and parts[1].endswith("c" * 40)


def test_rrf_breaks_ties_by_first_list(spark):
    lists = [spark.createDataFrame(rows, "query_id long, chunk_id long, rank int") for rows in ([(1, 10, 1), (1, 11, 2)], [(1, 11, 1), (1, 10, 2)])]
    assert [r.chunk_id for r in retrieval.rrf(lists, 5).orderBy("rank").collect()] == [10, 11]


def test_parents_respect_budget(spark):
    chunks = spark.createDataFrame([(i, 1, "H", i, "word " * 20) for i in range(5)], "chunk_id long, doc_id long, heading_path string, chunk_index int, content string")
    hits = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.95)], "query_id long, chunk_id long, rank int, score double")
    (whole,) = retrieval.parents(hits, chunks, 10_000).collect()
    assert whole.kept == 5 and whole.score == 0.95 and whole["rank"] == 1
    (some,) = retrieval.parents(hits, chunks, 80).collect()
    assert 1 <= some.kept < 5


def test_context_cut_at_line(spark):
    long = "\n".join("word " * 20 for _ in range(40))
    blocks = spark.createDataFrame([(1, 1, "a", "short"), (1, 2, "b", long), (1, 3, "c", "never")], "query_id long, rank int, label string, content string")
    (row,) = retrieval.contexts(blocks, 200).collect()
    assert row.context.startswith("[a]\nshort\n\n---\n\n[b]\n") and "never" not in row.context and len(row.context) < len(long)


def test_metrics_without_hits_are_zero(spark):
    queries = spark.createDataFrame([(1,), (2,)], "id long")
    hits = spark.createDataFrame([(1, 1, 5, 50), (1, 2, 6, 51)], "query_id long, rank int, chunk_id long, doc_id long")
    gold = spark.createDataFrame([(1, 51), (2, 9)], "query_id long, doc_id long")
    rows = {r.query_id: r for r in evaluation.per_query(queries, hits, gold, 5).collect()}
    assert (rows[1].doc_recall, rows[1].doc_precision, rows[1].doc_mrr) == (1.0, 0.5, 0.5) and rows[2].doc_recall == 0.0 and rows[1].chunk_recall is None


def test_trim_drops_question_with_answer(spark):
    roles = ["user", "assistant"] * 3
    rows = spark.createDataFrame([(1, i, r, "x" * 100) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in sessions.trimmed(rows, 3, 100).orderBy("turn").collect()] == [4, 5]
    assert sessions.trimmed(rows, 3, 1000).count() == 6


def test_diff_states(spark):
    s = "path string, mtime long, size long, hash string"
    files = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 2, 1, "y"), ("d", 1, 1, "x")], s)
    manifest = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("e", 1, 1, "x")], s)
    assert {r.path: r.state for r in sync.diff(files, manifest).collect()} == {"a": "unchanged", "b": "touched", "c": "updated", "d": "added", "e": "removed"}
    assert {r.state for r in sync.diff(files, files).collect()} == {"unchanged"}


def test_admission_counts_the_far_edge(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 10, 60, 61, 71])], "user_id long, event_id long, ts timestamp")
    assert [r.ok for r in events.admitted(rows, "user_id", 60, 2).orderBy("event_id").collect()] == [True, True, False, True, True]


def test_stream_bursts_match_batch(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 1, 9, 10, 90_000])], "user_id long, event_id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.stream_bursts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user_id", 5)
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.n) for r in spark.table("bursts").collect()}
    assert got <= {(r.start, r.n) for r in events.bursts(rows, "user_id", 5).collect()} and len(got) == 2


def test_scan_skips_folders(spark, tmp_path):
    for name in ("a.md", "b/c.TXT", "b/d.pdf", "wiki/e.md", ".git/f.md", "b/node_modules/g.md"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(name)
    assert {r.relative for r in files.scan(spark, str(tmp_path / "root")).collect()} == {"a.md", "b/c.TXT"}


def test_decoding_chain(spark):
    raw = ["né".encode(), "检索系统".encode("gb18030"), b"caf\xe9", b"", None]
    rows = files.decoded(spark.createDataFrame(list(enumerate(raw)), "i int, content binary")).orderBy("i").collect()
    assert [r.text for r in rows] == ["né", "检索系统", "café", "", None]


def test_markdown_source(spark):
    def parse(c):
        r = one(spark, c, files.markdown_source)
        return r.content, r.title, r.metadata

    assert parse("---\ntitle: A\nk: 'v'\nk: w\n---\n## x\n# y\nz") == ("## x\n# y\nz", "y", {"title": "A", "k": "w"})
    assert parse("## x\nz") == ("## x\nz", "x", {"title": "x"})
    assert parse("---\nno end") == ("---\nno end", None, {})
    assert parse("") == ("", None, {})


def test_pages_to_markdown(spark):
    page = "<html><head><title>T</title></head><body><nav>no</nav><main><h2>A <b>b</b></h2><p>x <a href='/u'>y</a><br>z `</p><ul><li>1<ol><li>2</li></ol></li></ul><table><tr><th>a</th></tr><tr><td>b|</td><td>c</td></tr></table><pre class='lang-py'>  f\n    g</pre><blockquote><p>q</p></blockquote></main></body></html>"
    want = "## A **b**\n\nx [y](/u)\nz `\n\n- 1\n  1. 2\n\n| a |  |\n| --- | --- |\n| b\\| | c |\n\n```py\nf\n  g\n```\n\n> q\n"
    rows = html.to_markdown(spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (rows[0].title, rows[0].markdown, rows[0].n_fences) == ("T", want, 1)
    assert [(r.title, r.markdown) for r in rows[1:]] == [(None, "")] * 2


def test_tables_to_prose(spark):
    text = "p\n| h | i |\n|---|:-:|\n| a | b |\n|  | |\n| c |\nq\n  |--|\n| x |\n| - |"
    made = chunking.tables_to_prose(spark.createDataFrame([(1, text, "S", "🚀 二、API"), (2, text, None, None)], "doc_id long, content string, subject string, heading string"))
    got = {r.doc_id: r.content for r in made.collect()}
    assert got[1] == "p\nS的全部API如下：a b，c。\nq\n|--|\n| x |\n| - |" and "全部内容如下：a b，c。" in got[2]


def test_normal_ocr(spark):
    cases = {"# 标题： Ａ——Ｂ……": "标题:A-B...", "|---|:--|\n| *a_b* |": "a_b", "> ## x　y": "xy", "-5 是": "-5是", None: ""}
    for raw, want in cases.items():
        assert one(spark, raw, T.normal_ocr) == want == one(spark, want, T.normal_ocr)
    assert one(spark, "a_b", lambda c: T.normal_ocr(c, True)) == "ab"


def test_dataset_violations(spark):
    raw = ['{"id": "a", "question": "q", "gold_docs": ["/x/d.md", "d.md"]}', '{"id": "a", "question": "q", "gold_docs": []}', "[1]", '{"id": "b"}', "broken", None]
    checked = datasets.items(spark.createDataFrame(list(enumerate(raw)), "row int, raw string"))
    assert {(r.row, r.rule) for r in datasets.violations(checked).collect()} == {(1, "no gold documents"), (1, "repeated id"), (2, "not an object"), (3, "missing field"), (4, "not an object"), (5, "not an object")}
    assert [r.doc for r in datasets.gold(checked.where("row = 0")).collect()] == ["d.md"]


def test_index_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    indexing.build(rows.limit(0), str(tmp_path / "i"))
    assert indexing.build(rows, str(tmp_path / "i")).count() == 2
    new = spark.createDataFrame([(2, "c"), (3, "d")], "doc_id long, v string")
    assert {r.v for r in indexing.add(rows, new).collect()} == {"a", "b", "d"} and {r.v for r in indexing.add(rows, new, True).collect()} == {"a", "c", "d"}


def test_reserved_addresses(spark):
    bad = ["http://198.18.0.1/", "http://198.19.9.9", "http://192.0.2.5/x", "http://203.0.113.9", "http://192.0.0.1", "http://198.51.100.7"]
    good = ["http://198.20.0.1/", "http://192.0.3.5/x", "http://192.0.0.9", "http://198.51.101.7"]
    assert not any(one(spark, u, T.public_url) for u in bad) and all(one(spark, u, T.public_url) for u in good)


def test_quotes_of_pages():
    text = lambda page: html.convert(f"<body>{page}</body>")[1]
    assert text("<blockquote><p>a</p><p>b<br>c</p></blockquote><p>d</p>") == "> a\n>\n> b\n> c\n\nd\n"
    assert text("<blockquote>x<blockquote>y</blockquote>z</blockquote><blockquote>w</blockquote>") == "> x\n>\n> > y\n>\n> z\n\n> w\n"
    assert text("<blockquote>" * 60 + "deep" + "</blockquote>" * 60) == "> " * 60 + "deep\n"
    assert text("<blockquote> </blockquote>") == "" and text("<blockquote><pre>a\n\n b</pre></blockquote>") == "> ```\n> a\n>\n>  b\n> ```\n"


def test_dense_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [1.0, float("inf")])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    hits = retrieval.dense_topk(v, v, 5).collect()
    assert sorted((r.query_id, r.chunk_id, r.rank, r.score) for r in hits) == [(1, 1, 1, 1.0), (1, 2, 2, 0.6), (2, 1, 2, 0.6), (2, 2, 1, 1.0), (3, 3, 1, 1.0)]


def test_session_changes(spark):
    titles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "conv_id long, title string")
    messages = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "y"), (3, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    rows = [(1, 1, "append", None, "user", "m"), (1, 2, "append", None, "assistant", "n"), (1, 3, "rename", " new " + "q" * 60, None, None), (2, 4, "delete", None, None, None), (2, 5, "append", None, "user", "lost"), (3, 6, "delete", None, None, None), (3, 7, "create", "again", None, None), (3, 8, "append", None, "user", "first"), (4, 9, "create", "four", None, None), (5, 10, "append", None, "user", "none"), (5, 11, "rename", "none", None, None)]
    changes = spark.createDataFrame(rows, "conv_id long, at long, op string, title string, role string, text string")
    now, left = sessions.apply_changes(titles, messages, changes)
    assert {r.conv_id: r.title for r in now.collect()} == {1: "new " + "q" * 46, 3: "again", 4: "four"}
    assert sorted((r.conv_id, r.turn, r.text) for r in left.collect()) == [(1, 0, "x"), (1, 1, "m"), (1, 2, "n"), (3, 0, "first")]
    with pytest.raises(Exception, match="unknown change"):
        sessions.apply_changes(titles, messages, changes.withColumn("op", F.lit("merge")))[0].collect()


def test_own_rows_are_no_hits(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, embedding array<double>")
    hits = retrieval.without_own(retrieval.dense_topk(v, v, 4), 3).collect()
    got = {q: [r.chunk_id for r in sorted(hits, key=lambda r: r.rank) if r.query_id == q] for q in range(6)}
    assert got == {q: [i for i in range(6) if i != q][:3] for q in range(6)} and {r.rank for r in hits} == {1, 2, 3}


def test_recall_of_hashed_neighbours(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    asked = v.where("id % 20 = 0")
    exact, hashed = ({(r.query_id, r.chunk_id) for r in retrieval.without_own(f(asked, v, 11), 10).collect()} for f in (retrieval.dense_topk, retrieval.lsh_topk))
    assert len(exact & hashed) >= 0.9 * len(exact)


def test_error_rates_of_other_scripts(spark):
    rows = spark.createDataFrame([("né", "ne"), ("检索系统", "检系统"), ("", "x"), ("abc", None)], "reference string, got string")
    assert [r.cer for r in rows.select(T.char_error_rate(F.col("reference"), F.col("got")).alias("cer")).collect()] == [0.5, 0.25, None, 1.0]


def test_import_modes(spark):
    rows = lambda *ids, side: spark.createDataFrame([(i, side) for i in ids], "id long, side string")
    stored = {"chunks": rows(1, 2, side="old"), "manifest": rows(1, side="old"), "conversations": rows(7, 8, side="old")}
    snapshot = {"chunks": rows(2, 3, side="new"), "manifest": rows(3, side="new"), "conversations": rows(8, side="new"), "extra": rows(5, side="new")}
    keys, seen = dict.fromkeys(snapshot, "id"), {}
    for mode in ("merge", "replace"):
        after, counts = sync.import_snapshot(stored, snapshot, keys, mode)
        seen[mode] = {name: sorted((r.id, r.side) for r in t.collect()) for name, t in after.items()}
        assert {r.name: r.n for r in counts.collect()} == {"chunks": 2, "manifest": 1, "conversations": 1, "extra": 1}
    talks = [(7, "old"), (8, "new")]
    assert seen["merge"] == {"chunks": [(1, "old"), (2, "new"), (3, "new")], "manifest": [(1, "old")], "conversations": talks, "extra": [(5, "new")]}
    assert seen["replace"] == {"chunks": [(2, "new"), (3, "new")], "manifest": [(3, "new")], "conversations": talks, "extra": [(5, "new")]}
    assert sync.import_snapshot({}, snapshot, keys, "merge")[0]["manifest"].count() == 1
    with pytest.raises(ValueError):
        sync.import_snapshot(stored, snapshot, keys, "rebuild")


def test_syntheses(spark):
    answers = spark.createDataFrame([(1, 'Say "hi"?', " yes\n", "a1"), (2, " ", "x", "a2"), (3, "q", None, "a3"), (4, "?!", "ok", "a4")], "id long, question string, answer string, suffix string")
    sources = spark.createDataFrame([(1, 2, None, "", None, None), (1, 1, "n.md", "Top", 1.0, "/v/n.md")], "id long, rank int, file_name string, heading string, score double, file_path string")
    got = {r.id: r for r in sessions.syntheses(answers, sources, "2026-01-31T12:00:00").collect()}
    assert set(got) == {1, 4} and got[1].file_name == "2026-01-31-Say-hi-a1.md" and got[4].file_name == "2026-01-31-qa-a4.md"
    assert got[1].content.startswith('---\ntype: synthesis\ndate: 2026-01-31T12:00:00\nquestion: "Say \\"hi\\"?"\nsource_count: 2\n---\n\n# Say "hi"?\n\nyes\n\n## ')
    assert got[1].content.endswith("- [[n.md]] (Top) · 分数 1.000 · `/v/n.md`\n- [[unknown]] · 分数  · ``\n") and got[4].content.endswith("(0)\n\n")
