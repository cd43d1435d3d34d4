"""Periodic run detection: stretches of a text whose words repeat with one period.

A suffix automaton takes the words one by one; its link tree is held as a link-cut tree whose preferred paths are
the segments of one last occurrence. A new word recolours the path of its prefix to its own place. Each segment that
it meets says where its longest word string ended before; where that is no farther off than the string is long, two
copies touch, and the square is extended to its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakequill.llm.text import SPACES, doc_bytes, pieces, powers, span_hashes, window_sums, word_spans

#: Words of the windows by which text without runs is set aside, see `suspects`.
WINDOW = 5


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(last, period, size): up to the word `last`, a string of `size` words stands both here and `period` (at most size)
    earlier, and no nearer. Given for every segment that a word's path meets, in the order of words."""
    after: list[dict[int, int]] = [{}, {}]  # state 0 is none, 1 the root
    link, size = [0, 0], [0, 0]
    up, left, right, last = [0, 0], [0, 0], [0, 0], [-1, -1]  # the link-cut tree; last: of the path that a tree's top stands for

    def rotate(x: int) -> None:
        y = up[x]
        z = up[y]
        if left[z] == y and z:
            left[z] = x
        elif right[z] == y and z:
            right[z] = x
        else:
            last[x] = last[y]
        up[x], up[y] = z, x
        if left[y] == x:
            left[y] = w = right[x]
            right[x] = y
        else:
            right[y] = w = left[x]
            left[x] = y
        if w:
            up[w] = y

    def splay(x: int) -> None:
        while (y := up[x]) and (left[y] == x or right[y] == x):
            if (z := up[y]) and (left[z] == y or right[z] == y):
                rotate(y if (left[y] == x) == (left[z] == y) else x)
            rotate(x)

    def state(above: int, n: int, follows: dict[int, int]) -> int:
        after.append(follows)
        link.append(above)
        size.append(n)
        up.append(above)
        left.append(0)
        right.append(0)
        last.append(-1)
        return len(link) - 1

    whole = 1
    for i, word in enumerate(words):
        new, p = state(1, size[whole] + 1, {}), whole
        while p and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p:
            q = after[p][word]
            if size[q] > size[p] + 1:  # a copy for the shorter strings stands between q and what q hung on, on q's path
                copy = state(link[q], size[p] + 1, dict(after[q]))
                splay(q)
                left[copy], up[copy] = left[q], q
                if left[q]:
                    up[left[q]] = copy
                left[q], link[q] = copy, copy
                while p and after[p].get(word) == q:
                    after[p][word] = copy
                    p = link[p]
                q = copy
            link[new] = up[new] = q
        whole = new
        x, below = new, 0
        while x:
            splay(x)
            before = last[x]
            if before >= 0 and i - before <= size[x]:
                yield i, i - before, size[x]
            if right[x]:
                last[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        last[below] = i


def runs(words: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `least` words and `times` periods or more, by start and period."""
    found, ends = [], {}
    for i, period, size in squares(words):
        if ends.get(period, -1) < i:  # else of a run that is known
            start, stop = i - period - size + 1, i + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            ends[period] = stop - 1
            if stop - start >= max(least, times * period):
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def suspects(hashes: np.ndarray, at: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words (start, stop) that hold every run of all texts; text t has the words at[t]:at[t + 1].

    Exact: inside a run of at least `least` (6 or more) and `times` (4 or more) periods each window of five words
    stands again within the run, one period off. So windows without another one as near as a `times`-th of their
    stretch leave, until nothing changes; hashes that agree by chance only keep more.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(text[: max(0, n - WINDOW + 1)] == text[WINDOW - 1 :]) if n >= WINDOW else np.zeros(0, int)
    if not len(starts):
        return []
    keys = window_sums(hashes, starts, starts + WINDOW) + text[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    gap = np.where(same, starts[order[1:]] - starts[order[:-1]], n)
    near = np.full(len(starts), n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    keep = near < n
    while True:
        starts, near = starts[keep], near[keep]
        if not len(starts):
            return []
        # windows that touch or overlap within a text make a stretch
        edge = np.flatnonzero((starts[1:] > starts[:-1] + WINDOW) | (text[starts[1:]] != text[starts[:-1]])) + 1
        first, final = np.concatenate(([0], edge)), np.concatenate((edge, [len(starts)])) - 1
        length = starts[final] + WINDOW - starts[first]
        keep = times * near <= np.repeat(length, final - first + 1)
        keep &= np.repeat(length >= least, final - first + 1)
        if keep.all():
            return [*zip(starts[first].tolist(), (starts[final] + WINDOW).tolist(), strict=True)]


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, runs (an array of start, length, period by start and period) and collapsed of every document.

    docs: doc_id, text; other columns are ignored. Words are what stands between white space of ASCII, in the case they
    have, numbered from 0. A run is a stretch of words that repeat at a distance of `period`, the least such, which no
    neighbour prolongs, of `least` (6 at least) words and `times` (4 at least) periods or more. `collapsed`: the words
    left, joined by one space, when of every run only the first period stays. A null text counts as empty: no runs,
    collapsed empty. A null id stays; repeated rows are taken each; an empty table gives no rows.
    """
    if least < 6 or times < 4:
        raise ValueError("windows of five words tell runs of 6 words and 4 periods or more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column("text").to_pylist()
                data, starts, stops, at = word_spans(texts, lower=False)
                powers(len(data) + 1)
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                gone: dict[int, np.ndarray] = {}
                for a, b in suspects(span_hashes(data, starts, stops), at, least, times):
                    names: dict[bytes, int] = {}
                    ids = [names.setdefault(data[x:y], len(names)) for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                    t = int(np.searchsorted(at, a, "right")) - 1
                    for start, length, period in runs(ids, least, times):
                        start += a - int(at[t])
                        found[t].append((start, length, period))
                        gone.setdefault(t, np.zeros(at[t + 1] - at[t], bool))[start + period : start + length] = True
                collapsed = []
                for t, text in enumerate(texts):
                    words = text.split()
                    if t in gone:
                        words = [w for w, g in zip(words, gone[t].tolist(), strict=True) if not g]
                    collapsed.append(b" ".join(words))
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(r, key=lambda r: (r[0], r[2]))] for r in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(collapsed, pa.binary())], ["doc_id", "runs", "collapsed"])

    made = doc_bytes(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return made.select("doc_id", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts get a periodic end: with h the crc32 of the id and g = h // 10, if h
    is divisible by 10 each of the n words from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is worked out once

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n == 0, "").otherwise(bound(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + (i - s["a"]) % s["p"]))), " ")))

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, bound(words, tail)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of several the first, then that of least period; nulls without any) with its
    exponent in thousandths, and sha256 of all runs and of the collapsed text."""
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])), "\n")
    rows = found.withColumn("best", F.get(longest, F.lit(0)))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


assert len(SPACES) == 6  # bytes.split() splits at these
