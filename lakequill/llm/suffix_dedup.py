"""Removal of repeated passages by sparse suffix arrays.

Of all suffixes of a text only those that begin at content-selected positions are kept: the minimisers of word
k-grams. Each window of `least` words has one anchor, the least gram among its first WINDOW ones (the leftmost of
equal ones), chosen alike wherever the window stands, so two equal windows have equal anchors. Suffixes whose first
words (as many as every window has from its anchor on) recur are candidates. A candidate is extended to the left and
right: all windows that it anchors are sorted, and each is compared with its neighbours in that order. Equal
neighbours are a match, and the matched windows of an anchor, which overlap, make one passage.

Places whose windows are all the same are one row of the sort, so copies cost no more than their number. A place is
named by the row's id, a hash of its text and the word's position, so no numbering of rows has to hold between
scans, and rows of one id and text need no telling apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lakequill.llm.text import bitmap, doc_bytes, hashed_words, in_bitmap, kept, pieces, shingle_hashes, window_sums

GRAM = 8
WINDOW = 16
#: Bits of the filter of recurring keys: 16 for each key, within these powers of two (64 KB and 128 MB).
FEWEST, MOST = 19, 30
NO_ID = -(1 << 63)


def anchors(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor its position and the first and last window (by position) that it anchors. at: where texts
    begin, and the end. Every window of `least` words of a text has one anchor, and an anchor's windows lie in a row."""
    n = len(words) - least + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    gram = shingle_hashes(words, GRAM)
    low, place = gram[:n].copy(), np.arange(n)
    for i in range(1, WINDOW):
        less = gram[i : i + n] < low
        low[less] = gram[i : i + n][less]
        place[less] = np.flatnonzero(less) + i
    whole = np.flatnonzero(np.arange(n) + least <= np.repeat(at[1:], np.diff(at))[:n])
    anchor, first, many = np.unique(place[whole], return_index=True, return_counts=True)
    return anchor, whole[first], whole[first] + many - 1


def candidates(part: pa.RecordBatch, least: int) -> tuple[np.ndarray, ...]:
    """Word hashes and text starts of a batch; of each anchor its position, first and last window and key."""
    words, at = hashed_words(part.column("text").to_pylist())
    anchor, first, last = anchors(words, at, least)
    return words, at, anchor, first, last, window_sums(words, anchor, anchor + least - WINDOW + 1)


def keys(rows: DataFrame, least: int) -> DataFrame:
    """(key, n) of all anchors, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                key, n = np.unique(candidates(part, least)[5], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long")


def places(rows: DataFrame, least: int, recur: np.ndarray, whole: bool) -> DataFrame:
    """Anchors whose key may recur: around (a hash of all words in the anchor's windows), doc, name, pos and, if whole,
    key, lo (least reach to the left) and windows (a hash of each, from the reach `lo` up)."""
    shared = rows.sparkSession.sparkContext.broadcast(recur)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                words, at, anchor, first, last, key = candidates(part, least)
                some = in_bitmap(key, shared.value)
                anchor, first, last, key = anchor[some], first[some], last[some], key[some]
                text = pa.array(np.searchsorted(at, anchor, "right") - 1)
                around = window_sums(words, first, last + least)
                columns = [pa.array(around.astype(np.int64)), part.column("doc").take(text), part.column("name").take(text), pa.array(anchor - at[text])]
                if whole:
                    many = last - first + 1
                    ends = np.cumsum(many)
                    starts = np.repeat(last, many) - (np.arange(many.sum()) - np.repeat(ends - many, many))
                    windows = window_sums(words, starts, starts + least)
                    columns += [pa.array(key.astype(np.int64)), pa.array((anchor - last).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(windows.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["around", "doc", "name", "pos", "key", "lo", "windows"][: len(columns)])

    return rows.mapInArrow(run, "around long, doc long, name long, pos long" + ", key long, lo int, windows array<long>" * whole)


SORTED = ["w", "doc", "name", "pos"]


def neighbours(windows: DataFrame) -> DataFrame:
    """(around, l, later) of the windows that stand elsewhere too; windows: around, l, w, n and the first place that has
    the row's surroundings (doc, name, pos). later: an earlier place has the window.

    Ranges of the sorted order go to tasks, so a window of any number of places is split. A task sees its
    neighbours' last and first window in a table of two numbers a task, read back from the sorted rows.
    """
    rows = kept(windows.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                last = batch.column("w")[batch.num_rows - 1].as_py()
                first = batch.column("w")[0].as_py() if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "first": [first], "last": [last]})

    edge = sorted(tuple(r) for r in rows.select("w").mapInArrow(ends, "task long, first long, last long").collect())
    before = {t: (edge[i - 1][2] if i else None, edge[i + 1][1] if i + 1 < len(edge) else None) for i, (t, _, _) in enumerate(edge)}
    shared = rows.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(batch: pa.RecordBatch, last: int | None, after: int | None) -> pa.RecordBatch:
            w = batch.column("w").to_numpy()
            same = w[1:] == w[:-1]
            later = np.concatenate(([last is not None and w[0] == last], same))
            twice = later | np.concatenate((same, [after is not None and w[-1] == after])) | (batch.column("n").to_numpy() > 1)
            return pa.RecordBatch.from_arrays([batch.column("around"), batch.column("l"), pa.array(later)], ["around", "l", "later"]).filter(pa.array(twice))

        last, after = shared.value.get(TaskContext.get().partitionId(), (None, None))
        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield compared(held, last, batch.column("w")[0].as_py())
                    last = held.column("w")[held.num_rows - 1].as_py()
                held = batch
        if held is not None:
            yield compared(held, last, after)

    return rows.select("w", "around", "l", "n").mapInArrow(run, "around long, l int, later boolean")


def named(docs: DataFrame) -> DataFrame:
    """doc (id, NO_ID for null), name (a hash of the text) and text as bytes."""
    return doc_bytes(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("name"), "text")


def found_spans(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc, name, start, stop, later) of the first row of each id and text, in merged spans; and (doc, name, many) of
    the rows that share both."""
    if least < WINDOW + GRAM:
        raise ValueError(f"a passage must have {WINDOW + GRAM} words or more")
    rows = named(docs)
    twins = kept(rows.groupBy("doc", "name").agg(F.count("*").alias("many")).where("many > 1"))
    recurring = kept(keys(rows, least).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    bits = min(max(math.ceil(math.log2(16 * recurring.count() + 1)), FEWEST), MOST)
    recur = bitmap(recurring, "key", bits)
    place = F.struct("doc", "name", "pos")
    groups = kept(places(rows, least, recur, True).groupBy("around").agg(F.min(place).alias("f"), F.count("*").alias("n"), F.first("key").alias("key"), F.first("lo").alias("lo"), F.first("windows").alias("windows")))
    several = kept(groups.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"))
    apart = groups.join(several, "key", "left_semi").select("around", "n", "f.*", "lo", F.posexplode("windows").alias("i", "w"))
    matched = neighbours(apart.selectExpr("around", "lo + i as l", "w", "n", "doc", "name", "pos"))
    copies = groups.where("n > 1").select("around", F.explode(F.array(F.col("lo"), F.expr("lo + size(windows) - 1"))).alias("l"), F.lit(False).alias("later"))
    reach = matched.union(copies).groupBy("around").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.min(F.when(F.col("later"), F.col("l"))).alias("late_lo"), F.max(F.when(F.col("later"), F.col("l"))).alias("late_hi"))
    best = kept(reach.join(groups.select("around", "f"), "around"))
    # of places with the same surroundings all but the first go; the first goes where another one comes before it
    first = F.col("f") == place
    late = lambda c: F.when(first, F.col(f"late_{c}")).otherwise(F.col(c))
    span = lambda lo, hi, later: F.struct((F.col("pos") - hi).alias("start"), (F.col("pos") + least - lo).alias("stop"), F.lit(later).alias("later"))
    spans = places(rows, least, recur, False).join(best, "around").select("doc", "name", F.explode(F.array(span(F.col("lo"), F.col("hi"), False), span(late("lo"), late("hi"), True))).alias("s"))
    return merged(spans.select("doc", "name", "s.*").where("start is not null")), twins


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching (start, stop) of a doc, name and kind joined into one."""
    order = Window.partitionBy("doc", "name", "later").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach, 0).otherwise(1)
    run = spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc", "name", "later", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, start, stop, later, twin: the words [start, stop) of a text stand elsewhere too.

    docs: doc_id, text; other columns are ignored. Every word of a passage lies in a run of `least` words that
    another text or another place of the same text has, and all such words are found. Words are A-Z in lower case,
    split at ASCII white space. `later` tells whether an earlier place (in order of doc_id, then of a hash of the
    text, then of position) has the passage, so that it can go; a passage can have both kinds of rows, and rows of a
    kind don't overlap. Rows of docs that share id and text are one text here; where that has `least` words, a row
    with `twin` stands for all but one of them. A null, empty or short text has no rows; a null doc_id comes
    first in order; an empty table gives no rows. A text of any length is one text.
    """
    spans, twins = found_spans(docs, least)
    spans = kept(spans)
    copies = spans.where("not later").join(twins, ["doc", "name"], "left_semi").select("doc", "name", F.lit(True).alias("later"), "start", "stop", F.lit(True).alias("twin"))
    every = spans.select("doc", "name", "later", "start", "stop", F.lit(False).alias("twin")).union(copies)
    return every.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "start", "stop", "later", "twin")


def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts without the words of their spans; the words around a cut keep the white space before them."""
    import re

    def one(text: str | None, where) -> str | None:
        if text is None or where is None:
            return text
        parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
        gone = np.zeros(len(parts), bool)
        for s in where:
            gone[s["start"] : s["stop"]] = True
        left = "".join([p for p, g in zip(parts, gone, strict=True) if not g])
        return left + text[sum(map(len, parts)) :] if left else ""

    return pd.Series([one(t, w) for t, w in zip(texts, spans, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs with every passage that an earlier place has cut out of text (and n_chars, if there, counted anew).

    The words around a cut stay as they were, with the white space before each; a text that is all repeats
    becomes empty, and its row stays. All other columns, of whatever names, and rows are unchanged; of rows with one
    id and text any one keeps its text. Nulls, empty texts and tables: see repeats().
    """
    spans, twins = found_spans(docs, least)
    cuts = kept(spans.where("later").groupBy("doc", "name").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))

    def cut(some: DataFrame) -> DataFrame:
        text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.pandas_udf(without, "string")("row.text", "spans"))
        joined = some.select("row", "spans", text.alias("text"))
        size = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
        new = {"text": F.col("text"), "n_chars": size}
        return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

    if twins.isEmpty():
        return cut(rows.join(cuts, ["doc", "name"], "left"))
    long = spans.where("not later and start = 0").join(twins, ["doc", "name"], "left_semi").select("doc", "name", F.array(F.struct("start", "stop")).alias("whole"))
    both = rows.join(cuts, ["doc", "name"], "left").join(kept(long), ["doc", "name"], "left")
    same = kept(both.where("whole is not null").withColumn("i", F.monotonically_increasing_id()))
    first = same.groupBy("doc", "name").agg(F.min("i").alias("first"))
    told = same.join(first, ["doc", "name"]).withColumn("spans", F.when(F.col("i") == F.col("first"), F.col("spans")).otherwise(F.col("whole")))
    return cut(both.where("whole is null").select("row", "spans").union(told.select("row", "spans")))
