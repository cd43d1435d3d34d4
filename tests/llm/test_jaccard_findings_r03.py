"""The Jaccard join's filters lose nothing, and long texts that differ don't reach the exact check (findings of round 3)."""

import random

import numpy as np
from pyspark.sql import functions as F

from lakequill.llm import components, jaccard_join


def test_keys_that_recur_stay(spark):
    rng = random.Random(4)
    lists = [(i, [rng.randrange(-(1 << 62), 1 << 62) for _ in range(30)] + rng.sample(range(400), 20 * (i % 3))) for i in range(90)] + [(90, [])]
    times = {}
    for _, keys in lists:
        for key in keys:
            times[key] = times.get(key, 0) + 1
    got = jaccard_join.shared_alone(spark.createDataFrame(lists, "node long, keys array<long>").repartition(5)).collect()
    by = {r.node: r for r in got}
    assert len(by) == len(lists) and all(by[i].total == len(keys) for i, keys in lists)
    assert all([x for x in keys if times[x] > 1] == [x for x in by[i]["keys"] if times[x] > 1] for i, keys in lists)
    kept, alone = sum(len(r["keys"]) for r in got), sum(n == 1 for n in times.values())
    assert kept < sum(n for n in times.values() if n > 1) + 0.05 * alone


def test_long_texts_that_differ_are_told_by_signatures(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 9000, dtype=np.uint64)
    near = np.concatenate((base[:8600], rng.integers(0, 1 << 62, 300, dtype=np.uint64)))
    half = np.concatenate((base[:4500], rng.integers(0, 1 << 62, 4500, dtype=np.uint64)))
    sets = [base, near, half, rng.integers(0, 1 << 62, 5000, dtype=np.uint64), base[:100]]
    nodes = [(i, len(s), jaccard_join.signature(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) >= jaccard_join.LONG else None) for i, s in enumerate(sets)]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3), (3, 4)], "a long, b long")
    got = jaccard_join.likely(pairs, spark.createDataFrame(nodes, "node long, n long, full binary"), 85, 100)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (3, 4)]  # a small set is left to the exact check


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    frame = spark.createDataFrame(links, "a long, b long")
    few = sorted(map(tuple, components.components(frame).collect()))
    monkeypatch.setattr(components, "FEW", 10)
    assert few == sorted(map(tuple, components.components(frame).collect())) and (1040, 1000) in few
    assert components.components(frame).where(F.col("component") > F.col("node")).isEmpty()


def test_a_key_of_few_nodes_is_one_row_each(spark):
    """A node's row crosses the shuffle once for each key that others have too, and not at all with too few of them."""
    lists = [(i, 120, [7, 8, 9, 100 + i]) for i in range(5)] + [(5, 120, [7, 200]), (6, 10, [9])]
    nodes = spark.createDataFrame(lists, "node long, n long, keys array<long>").repartition(3)
    apart = spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "key long, blocks long")
    got = sorted((r.tile, r.node, r.role) for r in jaccard_join.members(nodes, apart, 85, 100).collect())
    assert got == sorted([(k, i, 0) for k in (7, 8, 9) for i in range(5)] + [(9, 6, 0)])  # node 5 has one key of the two that it needs
    heavy = spark.createDataFrame([(9, 3)], "key long, blocks long")
    split = jaccard_join.members(nodes.where("node in (0, 6)").withColumn("n", F.lit(10)), heavy, 85, 100).collect()
    assert all(sum(r.node == i and r.role == 3 for r in split) == 1 and sum(r.node == i and r.role == 4 for r in split) == 3 for i in (0, 6))


def test_small_tables_are_few_partitions(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(12)], "doc_id long, text string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert jaccard_join.classes(docs, 4, 85, 100).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_that_miss_the_threshold_are_told_by_their_signatures(spark):
    """Near copies of one text that link with nothing: tiles hand on few of their pairs, and all that link."""
    rng = np.random.default_rng(8)
    base, rows = rng.integers(0, 1 << 62, 400, dtype=np.uint64), []
    for i in range(40):  # two of them share 0.75 of their union
        s = np.concatenate((base[rng.permutation(400)[:370]], rng.integers(0, 1 << 62, 30, dtype=np.uint64)))
        rows.append((5, 0, i, len(s), bytearray(jaccard_join.signature(s, jaccard_join.MIDDLE)), i, 1, i, len(s), s))
    twin = np.concatenate((rows[0][-1][:390], rng.integers(0, 1 << 62, 10, dtype=np.uint64)))
    rows.append((5, 0, 40, 400, bytearray(jaccard_join.signature(twin, jaccard_join.MIDDLE)), 40, 1, 40, 400, twin))
    frame = spark.createDataFrame([r[:-1] for r in rows], "tile long, role int, node long, n long, sig binary, component long, size long, pivot long, o long")
    got = {tuple(r) for r in jaccard_join.tiles(frame, 85, 100, True, 2).collect()}
    assert (0, 40) in got and len(got) < 5


def test_only_keys_of_sets_that_may_link_stay(spark):
    lists = [(0, 100, [1, 2, 3]), (1, 110, [1]), (2, 1000, [2]), (3, 117, [3]), (4, 5000, [4, 5])]
    got = {r.node: (r.total, r["keys"]) for r in jaccard_join.shared_alone(spark.createDataFrame(lists, "node long, n long, keys array<long>").repartition(3), 85, 100).collect()}
    assert got == {0: (3, [1, 3]), 1: (1, [1]), 2: (1, []), 3: (1, [3]), 4: (2, [])}
