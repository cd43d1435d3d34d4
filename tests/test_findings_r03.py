"""Queries against their SQL on small made tables, and operators against plain code, for the findings of round 3."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Row, functions as F

from lakequill.functions import text as T
from lakequill.operators import chunking, inverted, retrieval, retrieve
from lakequill.plans import corpus_queries, queries  # noqa: F401 (registers its queries)


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for key, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{key}.parquet")
        con.execute(f"CREATE VIEW {key} AS SELECT * FROM read_parquet('{folder}/{key}.parquet')")
    got = sorted((tuple(r) for r in queries.Q[name](spark, str(folder)).collect()), key=repr)
    assert got == sorted(con.execute(queries.SQL[name]).fetchall(), key=repr)
    return got


def test_texts_without_words(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "f1_context_tokens", documents=[{"doc_id": i, "text": t} for i, t in enumerate(["é", "", "a é", None, "été x_1"])])
    assert dict(got) == {0: None, 1: None, 2: 1, 3: None, 4: 3}


def test_all_blocks_are_appended(spark, tmp_path):
    texts = ["\n".join(f"line {i}" for i in range(300)), "a\nb\nc\n\nd", "a\nb\nc\n  \nd", "a", ""]
    same_as_sql(spark, tmp_path, "c18_appended_text", documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])


def test_titles_that_end_within_an_entity(spark, tmp_path):
    heads = ["a &amp;&amp", "b", "c", "&lt;d&gt; &lt", "e", "f", "g & h &am"]
    same_as_sql(spark, tmp_path, "s7_markdown_titles", pages=[{"page_id": i, "url": "https://x.org/a", "html": f"<html><head><title>t</title></head><body><article><h1>{h}</h1><p>p</p></article></body></html>"} for i, h in enumerate(heads)])


def test_dense_search_holds_neither_table(spark, monkeypatch):
    """Blocks of 16 vectors and chunks of 8 queries against a plain product, with ties; no join has more than blocks as rows."""
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    v[:, 0] += 3
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(rng.permutation(300), v)], "id long, embedding array<double>").repartition(5)
    asked = rows.where("id % 10 = 0")
    by_id = {r.id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows.collect()}
    want = {(q, i, n + 1, s) for q in range(0, 300, 10) for n, (s, i) in enumerate(sorted(((round(float(np.clip(by_id[q] @ by_id[i], 0, 1)), 6), i) for i in by_id), key=lambda x: (-x[0], x[1]))[:7])}
    for f in (retrieval.dense_topk, retrieval.lsh_topk):  # with 24 wide tables every pair meets
        assert {(r.query_id, r.chunk_id, r["rank"], r.score) for r in f(asked, rows, 7).collect()} == want
    sizes = [len(r.ids) // 8 for r in retrieval.blocks(rows, 16).collect()]
    assert max(sizes) == 16 and sum(sizes) == 300
    narrow = retrieval.lsh_topk(asked, rows, 7, bucket=0.01, tables=1).count()
    assert len(asked.collect()) <= narrow < len(want)


def test_written_rows_have_a_size(spark):
    rows = retrieve.written(spark.range(10).selectExpr("id", "id * 2 as twice"))
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000 and rows.count() == 10


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_equal_the_whole_table(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé検😀"[: rng.randint(1, 6)]) for _ in range(n))
    pairs = [(word(rng.randint(0, 90)), word(rng.randint(0, 90))) for _ in range(300)] + [("", ""), ("a", ""), ("ab", "ba")]
    pairs += [(a, "".join(c for c in a if rng.random() > 0.1) + "x") for a, _ in pairs[:50]]
    assert [T.edits(*p) for p in pairs] == [plain_edits(*p) for p in pairs]
    rows = spark.createDataFrame([("abc", "abd"), (None, "x"), ("x", None)], "a string, b string")
    assert [r.d for r in rows.select(T.edit_distance("a", "b").alias("d")).collect()] == [1, None, None]


def test_edits_of_long_lines_are_quick():
    """200,000 characters with one letter misread, as ocr_pairs() has them: the whole table has 40,000,000,000 cells."""
    line = "the other letters here " * 9_000
    began = time.time()
    assert T.edits(line, line.replace("e", "c")) == line.count("e") and T.edits(line, "# " + line) == 2
    assert time.time() - began < 5


def test_tables_of_scattered_cells(spark):
    """Cells out of order, twice in one column, with gaps, nulls and over many partitions; each text is shuffled once."""
    cells = [(1, 0, 0, "a|b"), (1, 0, 1, "c\nd"), (1, 0, 3, "gap"), (1, 1, 1, "z"), (1, 1, 0, "y"), (1, 1, 0, "x"), (1, 2, 0, " "), (1, 2, 1, None), (2, 0, 0, ""), (3, 5, None, "n"), (3, 5, 0, "o"), (3, None, 0, "top"), (None, 0, 0, "who")]
    want = {1: "| a\\|b | c d | gap |\n| --- | --- | --- |\n| x | y | z |", 3: "| top |  |\n| --- | --- |\n| n | o |", None: "| who |\n| --- |"}
    rows = spark.createDataFrame(cells, "doc_id long, row int, col int, text string")
    for parts in (rows.coalesce(1), rows.repartition(7)):
        assert {r.doc_id: r.content for r in chunking.render_tables(parts).collect()} == want
    assert chunking.render_tables(rows.limit(0)).count() == 0
    plan = chunking.render_tables(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Window" not in plan


def test_packing_holds_few_texts_as_python_strings(spark):
    texts = ["\n".join(f"part {i} of {j}" for i in range(j % 7)) for j in range(150)] + [None, "", "\n\n", "x" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    whole = rows.select("doc_id", chunking.packed(F.col("text"), 30, 5, "\n").alias("p"))
    assert "], 250" in whole._jdf.queryExecution().executedPlan().toString()  # Arrow's arrays, not a batch as pandas' strings
    got = {r.doc_id: r.p for r in whole.collect()}
    assert got[150] is None and got[151] == [] and got[152] == [] and got[153] == ["x" * 50] and got[2] == ["part 0 of 2\npart 1 of 2"] and len(got[6]) > 1


def test_hits_meet_chunks_without_a_shuffle(spark):
    """r12's plan over sf0.001: chunks (all lines of all documents) are joined where they are read, the hits being small files."""
    d = "/root/testdata/sf0.001"
    for name in ("r7_down_weight", "r11_retrieve", "r12_parents"):
        frame = queries.Q[name](spark, d)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("== Initial Plan ==")[0] and "CartesianProduct" not in plan
    before = queries.bm25(spark, d).inputFiles()
    assert before == queries.bm25(spark, d).inputFiles()  # searched once, for all queries


def test_terms_are_shuffled_as_numbers(spark):
    postings = spark.createDataFrame([(1, 2, "a", 1), (1, 2, "b", 1), (2, 1, "b", 1), (3, 1, "z", 1)], "chunk_id long, dl long, term string, tf long")
    wanted = [Row(query_id=7, term="a", times=1, idf=1.0), Row(query_id=7, term="b", times=1, idf=0.5)]
    got = inverted.by_chunk(postings, wanted, 1.3, 5, 1.5, 0.75)
    assert sorted(r.chunk_id for r in got.collect()) == [1, 2]
    shuffled = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Repartition" in x)
    assert "term" not in shuffled and "code" in got._jdf.queryExecution().optimizedPlan().toString()
