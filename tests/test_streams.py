import datetime
import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakequill.sources import files
from lakequill.streaming import events, ingest, keyed

EVENTS = "user_id long, event_id long, ts timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_admission_of_a_stream_equals_the_batch(spark, tmp_path):
    """Rows out of order, a late one, a key's rows over three runs; the state goes when its window has passed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    waves = [[(1, 0, at(0)), (1, 1, at(10)), (2, 9, at(5)), (1, 3, at(61)), (1, 2, at(60))], [(1, 4, at(71)), (1, 5, at(64)), (3, 6, at(130)), (None, 7, at(90)), (3, 8, None)], [(1, 10, at(20)), (3, 11, at(131)), (3, 12, at(900))]]
    seen = []
    for wave in waves:
        put(spark, source, wave)
        query = keyed.started(keyed.stream_admitted(spark.readStream.schema(EVENTS).parquet(source), "user_id", 60, 2, "30 seconds"), out)
        seen.append([(s["numRowsDroppedByWatermark"], s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"]])
    got = {tuple(r) for r in spark.read.parquet(f"{out}/rows").collect()}
    all_rows = spark.createDataFrame([r for wave in waves for r in wave if r[1] not in (10, 7, 8, 12)], EVENTS)  # late, without a key or a time, not decided yet
    assert got == {tuple(r) for r in events.admitted(all_rows, "user_id", 60, 2).collect()}
    assert sum(n for n, _ in seen[2]) == 1 and sum(n for n, _ in seen[0]) == 0  # the late row is counted
    assert seen[2][-1][1] <= 3  # of all keys only the row that waits, its timer and its key are left


def test_admission_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(0)), (1, 3, None), (None, 4, at(0)), (None, 5, at(1)), (None, 6, at(2))], EVENTS).withColumn("ok", F.lit(1))
    assert {r.event_id: r.ok for r in events.admitted(rows, "user_id", 60, 2).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    assert events.admitted(rows.limit(0), "user_id", 60, 2).count() == 0
    many = spark.range(200_000).select(F.lit("k").alias("key"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    assert events.admitted(many, "key", 60, 3).where("ok").count() == 9837  # three of every 61 seconds


def test_idle_keys_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, 0, at(0)), (1, 1, at(20)), (1, 2, at(60)), (2, 3, at(5)), (3, 4, at(1000))])
    rows = keyed.written(keyed.stream_idle(spark.readStream.schema(EVENTS).parquet(source), "user_id", 30, "0 seconds"), out)
    assert {(r.user_id, r["last"]) for r in rows.collect()} == {(1, at(20)), (1, at(60)), (2, at(5))}
    put(spark, source, [(2, 5, at(1100)), (2, 6, at(1101)), (1, 7, at(1200))])
    query = keyed.started(keyed.stream_idle(spark.readStream.schema(EVENTS).parquet(source), "user_id", 30, "0 seconds"), out)
    assert {(r.user_id, r["last"]) for r in spark.read.parquet(f"{out}/rows").collect()} == {(1, at(20)), (1, at(60)), (2, at(5)), (3, at(1000)), (2, at(1101))}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # the keys 2 and 3 hold nothing


FILES = "path string, mtime long, text string"


def cut(rows):
    return rows.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def test_ingest_replaces_files(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")

    def run(*rows):
        spark.createDataFrame([*rows], FILES).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(FILES).parquet(source), cut, index)
        return lines()

    def lines():
        out = {}
        for r in ingest.stored(spark, index, "path string, pos int, line string").orderBy("path", "pos").collect():
            out.setdefault(r.path, []).append(r.line)
        return out

    assert run(("a", 1, "x\ny"), ("b", 1, "z"), ("c", 1, None), (None, 1, "lost")) == {"a": ["x", "y"], "b": ["z"]}
    # a is shorter now, b can't be read, c can, d comes twice, the later row first
    assert run(("a", 2, "w"), ("b", 2, None), ("c", 2, "c"), ("d", 3, "new"), ("d", 2, "old")) == {"a": ["w"], "b": ["z"], "c": ["c"], "d": ["new"]}
    written = spark.read.parquet(f"{index}/chunks").count()
    assert run(("a", 2, "w"), ("c", 9, "c")) == {"a": ["w"], "b": ["z"], "c": ["c"], "d": ["new"]}
    assert spark.read.parquet(f"{index}/chunks").count() == written  # neither the same file nor a touched one is chunked again
    assert {r.path: r.mtime for r in ingest.manifest(spark, index).collect()} == {"a": 2, "b": 1, "c": 9, "d": 3}
    # a batch that runs again, as after a failure, changes nothing
    again = spark.createDataFrame([("a", 2, "w"), ("b", 2, None), ("c", 2, "c"), ("d", 3, "new")], FILES)
    ingest.apply(again, ingest.STRIDE, index, cut)
    assert lines() == {"a": ["w"], "b": ["z"], "c": ["c"], "d": ["new"]}
    ingest.sweep(spark.createDataFrame([("a",), ("d",), ("e",)], "path string"), index)
    assert lines() == {"a": ["w"], "d": ["new"]}
    assert run(("b", 10, "back"), ("a", 10, "v")) == {"a": ["v"], "b": ["back"], "d": ["new"]}


def test_jobs_without_a_checkpoint_folder(tmp_path):
    """A session of its own, whose configuration names no folder."""
    script = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
for name in ("s1_scan", "c8_index_build", "s13_export", "t2_ingest"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""
    root = str(pathlib.Path(__file__).parent.parent)
    ran = subprocess.run([sys.executable, "-c", script], cwd=root, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "all ran" in ran.stdout, ran.stderr[-2000:]


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://x:1", lambda self: None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch(Session())
