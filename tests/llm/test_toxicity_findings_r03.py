"""Toxicity learns from all labelled rows, shard by shard (F6 of round 3)."""

import random

import numpy as np
from pyspark.sql import functions as F

from lakequill.llm import toxicity


def test_every_labelled_row_teaches(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["sun", "day", "tree", "road", "house", "walk"]) for _ in range(9)) + (f" vile{i % 20}" if i % 2 else f" kind{i % 20}") for i in range(3400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.labelled(docs, labels, (4, 2))
    assert rows.count() == labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).count()  # 1,275 of each class, once 1,500 at most
    assert rows.select("shard").distinct().count() == 2
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    # words that rows of one class beyond any first ones have are known too
    scores = toxicity.score(docs, labels, (4, 2)).join(labels, "doc_id").where(held).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in scores]) > 0.98
    # the order of rows and their partitions move a score by no more than single precision does
    again = toxicity.score(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3), (4, 2)).collect()
    by = {r.doc_id: r.score for r in again}
    assert len(by) == 3400 and max(abs(by[r.doc_id] - r.score) for r in scores) < 1e-3


def test_no_row_is_left_out_by_a_count(spark):
    rows = 3300
    docs = spark.range(rows).selectExpr("id as doc_id", "concat('w', id) as text")
    got = toxicity.labelled(docs, docs.selectExpr("doc_id", "cast(doc_id >= 1650 as int) as toxic"), None)
    assert got.count() == rows and got.where("toxic = 1").count() == 1650


def test_changes_of_shards_are_averaged():
    first, one, two = (toxicity.Teacher() for _ in range(3))
    one.net.table[7], one.sums[7], one.net.bias[0] = 1.0, 4.0, 0.5
    two.net.table[7], two.sums[7], two.net.table[9], two.sums[9] = 3.0, 2.0, -1.0, 1.0
    import pyarrow as pa

    batches = []
    for t in (one, two):
        ids, change = t.changes(first)
        for part in np.unique(ids // toxicity.DEALT):
            some = ids // toxicity.DEALT == part
            batches.append(pa.RecordBatch.from_pydict({"part": [int(part)], "ids": [ids[some].tobytes()], "change": [change[some].tobytes()]}))
    batches.sort(key=lambda b: b.column("part")[0].as_py())
    state = toxicity.Teacher()
    for out in toxicity.averaged(iter(batches)):
        state.take(np.frombuffer(out.column("ids")[0].as_py(), np.int64), np.frombuffer(out.column("change")[0].as_py(), np.float64).reshape(-1, toxicity.SIZE + 1))
    assert np.allclose(state.net.table[7], 2.0, atol=1e-5) and np.allclose(state.net.table[9], -1.0, atol=1e-5)
    assert abs(state.sums[7] - 3) < 1e-5 and abs(state.net.bias[0] - 0.25) < 1e-5


def test_changes_go_in_two_bytes():
    change = np.random.default_rng(1).normal(0, 1, (50, toxicity.SIZE + 1)).astype(np.float32) * np.float32(1e-9) ** np.linspace(0, 1, 50, dtype=np.float32)[:, None]
    sent = np.frombuffer(toxicity.halved(change).tobytes(), np.uint8)
    assert len(sent) == 2 * change.size
    assert np.allclose(toxicity.widened(sent, 50), change, rtol=1 / 256, atol=0)
    assert np.array_equal(toxicity.widened(np.frombuffer(change.tobytes(), np.uint8), 50), change)


def test_each_text_meets_each_label(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (4, "x"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (3, 0), (9, 1), (4, 7)], "doc_id long, toxic int")
    got = sorted((r.doc_id, bytes(r.text), r.toxic) for r in toxicity.labelled(docs, labels, None).collect())
    assert got == [(1, b"a", 0), (1, b"a", 1), (1, b"b", 0), (1, b"b", 1), (2, b"c", 1), (3, b"", 0)]
