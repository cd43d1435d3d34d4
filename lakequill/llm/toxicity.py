"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of hashed tables, of the word and of its first eight bytes. Filters of
several widths slide over a whole text; the greatest value of each goes into a logistic layer. Scores are fitted to
labelled rows that training held back, and so is a threshold for each language. All labelled rows teach: shards of them
train side by side, and their nets are averaged after each round.
"""

from __future__ import annotations

import copy
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import bitmap, doc_bytes, fold, in_bitmap, kept, pieces, span_hashes, word_spans

#: Rows of each hashed table (a power of two), length of an embedding, filters of each width, bytes of a word's beginning.
BITS, SIZE, FILTERS, WIDTHS, HEAD = 17, 16, 16, (1, 2, 3), 8
PAD = 2 << BITS
#: Letters A-Z in lower case, ASCII punctuation as spaces.
FOLDED = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
#: Empty places before and after each text, so that no window meets two texts.
GAP = max(WIDTHS) - 1
#: Places whose filters are worked out at once.
STRIP = 1 << 16
#: Labelled documents of a shard, rows of the net that are averaged together, steps of a logit.
SHARD, DEALT, STEP = 6000, 1024, 64
#: Where rows that are not the table's begin.
DENSE = (PAD // DEALT + 1) * DEALT


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the table of words and in that of beginnings for each place of all texts, and where each text begins."""
    data, starts, stops, at = word_spans([t.translate(FOLDED) for t in texts], lower=False)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    begin = at + 2 * GAP * np.arange(len(at))
    spot = np.arange(len(starts)) + 2 * GAP * text + GAP
    words, heads = np.full(begin[-1] + GAP, PAD), np.full(begin[-1] + GAP, PAD)
    mask = np.uint64((1 << BITS) - 1)
    words[spot] = span_hashes(data, starts, stops) & mask
    heads[spot] = (span_hashes(data, starts, np.minimum(stops, starts + HEAD)) & mask) + np.uint64(1 << BITS)
    return words, heads, begin


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (PAD + 1, SIZE)).astype(np.float32)
        self.table[PAD] = 0
        self.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out, self.bias = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)

    def embedded(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return self.table[words] + self.table[heads]

    def slid(self, x: np.ndarray, n: int) -> np.ndarray:
        """Each filter at each of the first n places."""
        every = x @ np.concatenate([f[o] for f in self.filters for o in range(len(f))], axis=1)
        z, k = np.empty((n, FILTERS * len(WIDTHS)), np.float32), 0
        for i, w in enumerate(WIDTHS):
            part = z[:, i * FILTERS : (i + 1) * FILTERS]
            part[:] = every[:n, k : k + FILTERS]
            for o in range(1, w):
                part += every[o : n + o, k + o * FILTERS : k + (o + 1) * FILTERS]
            k += w * FILTERS
        return z

    def peaks(self, words: np.ndarray, heads: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest value of each filter over each text and its first place, strip by strip, so that a very long
        text needs no more room than others."""
        top = np.full((len(begin) - 1, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        place = np.zeros(top.shape, np.int64)
        for a in range(0, begin[-1], STRIP):
            b = min(a + STRIP, begin[-1])
            z = self.slid(self.embedded(words[a : b + GAP], heads[a : b + GAP]), b - a)
            out = (begin[1:, None] - np.arange(1, GAP + 1)).ravel() - a  # windows from there would meet the next text
            z[out[(out >= 0) & (out < b - a)]] = -np.inf
            first = int(np.searchsorted(begin, a, "right")) - 1
            inner = begin[(begin > a) & (begin < b)] - a
            for t, (i, j) in enumerate(zip([0, *inner], [*inner, b - a]), first):
                at = z[i:j].argmax(axis=0)
                value = z[i + at, np.arange(z.shape[1])]
                better = value > top[t]
                top[t, better], place[t, better] = value[better], (a + i + at)[better]
        return top, place

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return np.maximum(self.peaks(*places(texts))[0] + self.shift, 0) @ self.out + self.bias[0]


class Teacher:
    """A net in training: by Adam, the table by Adagrad a row. Its state goes to the tasks and what they changed comes back."""

    def __init__(self, seed: int = 5):
        self.net, self.step = Net(seed), 0
        self.sums = np.zeros(len(self.net.table), np.float32)
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.dense()]

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, self.net.shift, self.net.out, self.net.bias]

    def learn(self, ready: list[tuple], labels: np.ndarray, weight: np.ndarray, paces: list[float], rng: np.random.Generator, batch: int = 16) -> None:
        """Once for each pace over all texts, as places() gives them; a third of the pooled filters is left out at random
        each time."""
        net, dense, n_filters = self.net, self.dense(), FILTERS * len(WIDTHS)
        for pace in paces:
            order = rng.permutation(len(ready))
            for some in np.array_split(order, max(1, len(order) // batch)):
                self.step += 1
                words, heads = (np.concatenate([ready[i][k][: ready[i][2][1]] for i in some] + [np.full(GAP, PAD)]) for k in (0, 1))
                begin = np.concatenate(([0], np.cumsum([ready[i][2][1] for i in some])))
                pooled, best = net.peaks(words, heads, begin)
                pooled += net.shift
                alive = (pooled > 0) * (rng.random((len(some), n_filters)) > 0.33) * np.float32(1.5)
                pooled = pooled * alive
                off = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias[0], -30, 30))) - labels[some]) * weight[some] / len(some)
                back = (off[:, None] * net.out * alive).astype(np.float32)
                gradients, touched = [], []
                for i, w in enumerate(WIDTHS):
                    own = slice(i * FILTERS, (i + 1) * FILTERS)
                    d = np.empty_like(net.filters[i])
                    for o in range(w):
                        at = best[:, own] + o
                        d[o] = np.einsum("dfe,df->ef", net.embedded(words[at], heads[at]), back[:, own])
                        touched.append((at.ravel(), (back[:, own, None] * net.filters[i][o].T[None]).reshape(-1, SIZE)))
                    gradients.append(d)
                gradients += [back.sum(axis=0), pooled.T @ off, np.array([off.sum()])]
                for p, g, (m, v) in zip(dense, gradients, self.moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= pace * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
                at, change = np.concatenate([a for a, _ in touched]), np.concatenate([c for _, c in touched])
                ids, place = np.unique(np.concatenate((words[at], heads[at])), return_inverse=True)
                total = np.zeros((len(ids), SIZE), np.float32)
                np.add.at(total, place, np.concatenate((change, change)))
                ids, total = (ids[:-1], total[:-1]) if ids[-1] == PAD else (ids, total)
                self.sums[ids] += (total * total).mean(axis=1)
                net.table[ids] -= 3 * pace * total / (np.sqrt(self.sums[ids])[:, None] + 1e-8)

    def flat(self) -> np.ndarray:
        """All that is not the table in rows as wide as a row of the table and its sum."""
        every = np.concatenate([x.ravel() for x in [*self.dense(), *[m for pair in self.moments for m in pair]]]).astype(np.float64)
        return np.append(every, np.zeros(-len(every) % (SIZE + 1))).reshape(-1, SIZE + 1)

    def changes(self, before: Teacher) -> tuple[np.ndarray, np.ndarray]:
        """Rows that differ from an earlier state and by how much."""
        ids, more = np.flatnonzero(self.sums != before.sums), self.flat() - before.flat()
        change = np.concatenate((self.net.table[ids] - before.net.table[ids], (self.sums[ids] - before.sums[ids])[:, None]), axis=1)
        return np.concatenate((ids, DENSE + np.arange(len(more)))).astype(np.int32), np.concatenate((change, more)).astype(np.float32)

    def take(self, ids: np.ndarray, change: np.ndarray) -> None:
        rows, flat = ids < DENSE, self.flat()
        self.net.table[ids[rows]] += change[rows, :SIZE].astype(np.float32)
        self.sums[ids[rows]] += change[rows, SIZE].astype(np.float32)
        flat[ids[~rows] - DENSE] += change[~rows]
        values, at = flat.ravel(), 0
        for x in [*self.dense(), *[m for pair in self.moments for m in pair]]:
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size


def labelled(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None) -> DataFrame:
    """doc_id, toxic, lang, text, back (held back from the net, about every fourth) and shard of all labelled documents
    outside the held-out fold; the rows of a shard stand in one partition, in order."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    known = kept(known.distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(known, "doc_id", min(max((16 * known.count()).bit_length(), 19), 30)))

    def told(ids: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(ids.to_numpy(), shared.value))

    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    some = doc_bytes(docs, lang.alias("lang")).where("doc_id is not null").where(F.pandas_udf(told, "boolean")("doc_id"))
    drawn = F.crc32(F.reverse(F.col("doc_id").cast("string")))
    shards = max(1, -(-known.count() // SHARD))
    both = some.withColumn("toxic", F.lit(None).cast("int")).unionByName(known.selectExpr("doc_id", "cast(null as string) lang", "cast(null as binary) text", "toxic"))
    both = both.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text with each label of its document, whose labels stand first."""
        doc, told = None, []
        for batch in batches:
            row, toxic = [], []
            for i, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), strict=True)):
                if d != doc:
                    doc, told = d, []
                if y is None:
                    row += [i] * len(told)
                    toxic += told
                else:
                    told.append(y)
            some = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("shard"), some.column("doc_id"), pa.array(toxic, pa.int32()), some.column("lang"), some.column("text")], ["shard", "doc_id", "toxic", "lang", "text"])

    # a text crosses one shuffle
    dealt = both.repartitionById(min(shards, 1000), F.expr(f"cast(shard * {min(shards, 1000)} div {shards} as int)")).sortWithinPartitions("shard", "doc_id", F.col("toxic").asc_nulls_last(), "text", "lang")
    return kept(dealt.mapInArrow(met, "shard long, doc_id long, toxic int, lang string, text binary").withColumn("back", drawn % 4 == 3).select("doc_id", "toxic", "lang", "text", "back", "shard"))


def halved(x: np.ndarray) -> np.ndarray:
    """Single precision rounded to its first 16 bits."""
    return (x.astype(np.float32).view(np.uint32) + np.uint32(0x8000) >> np.uint32(16)).astype(np.uint16)


def widened(data: np.ndarray, rows: int) -> np.ndarray:
    """The numbers of so many rows, sent in four bytes each or, by halved(), in two."""
    x = data if len(data) == 4 * rows * (SIZE + 1) else (data.view(np.uint16).astype(np.uint32) << np.uint32(16)).view(np.uint8)
    return x.view(np.float32).reshape(rows, SIZE + 1)


def taught(rows: DataFrame, rounds: int = 8, steps: int = 700, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Net:
    """A net trained on all rows. In each round every shard goes on from the same state, over its rows once or as often
    as make `steps` batches in all rounds; what the shards changed in a row is averaged over those that changed it. Both
    classes have the same weight. Rows of the table that no text moved are zero."""
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    shards = rows.select("shard").distinct().count()
    each = max(1, -(-steps * batch * shards // (sum(n.values()) * rounds)))
    heavy = {k: sum(n.values()) / (2 * m) for k, m in n.items()}
    state = Teacher(seed)
    for turn in range(rounds):
        paces = [rate * (1 - (turn + i / each) / rounds) for i in range(each)]
        sent = rows.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, paces: list[float] = paces, sent=sent) -> Iterator[pa.RecordBatch]:
            shard, ready, labels = None, [], []

            def learnt() -> pa.RecordBatch:
                now, y = copy.deepcopy(sent.value), np.array(labels)
                now.learn(ready, y, np.array([heavy[k] for k in labels]), paces, np.random.default_rng([seed, turn, shard]), batch)
                ids, change = now.changes(sent.value)
                part = (ids // DEALT).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = [*cuts[1:], len(ids)]
                return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([ids[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()), pa.array([(halved(change[i:j]) if ids[i] < DENSE else change[i:j]).tobytes() for i, j in zip(cuts, ends)], pa.binary())], ["part", "ids", "change"])

            for some in batches:
                for s, y, text in zip(some.column("shard").to_pylist(), some.column("toxic").to_pylist(), some.column("text"), strict=True):
                    if s != shard and ready:
                        yield learnt()
                        ready.clear()
                        labels.clear()
                    shard = s
                    ready.append(tuple(x.astype(np.int32) for x in places([text.as_py()])))
                    labels.append(y)
            if ready:
                yield learnt()

        changed = rows.select("shard", "toxic", "text").mapInArrow(run, "part long, ids binary, change binary")
        found = changed.repartition("part").sortWithinPartitions("part").mapInArrow(averaged, "part long, ids binary, change binary").toArrow()  # at most a row of the net each
        for ids, change in zip(found["ids"], found["change"], strict=True):
            state.take(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(change.as_buffer(), np.float64).reshape(-1, SIZE + 1))
        state.step += each * max(1, sum(n.values()) // (shards * batch))
        sent.unpersist()
    state.net.table[state.sums == 0] = 0
    return state.net


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's mean change over the shards that changed it, from rows sorted by part; summed as whole numbers, so that
    no order matters."""
    part, total, many = None, np.zeros((DEALT, SIZE + 1), np.int64), np.zeros(DEALT, np.int64)

    def out() -> pa.RecordBatch:
        ids = np.flatnonzero(many)
        mean = total[ids] / many[ids, None] / 2.0**32
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([(ids + part * DEALT).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["part", "ids", "change"])

    for batch in batches:
        for p, ids, change in zip(batch.column("part").to_pylist(), batch.column("ids"), batch.column("change"), strict=True):
            if p != part and part is not None:
                yield out()
                total[:], many[:] = 0, 0
            part = p
            at = np.frombuffer(ids.as_buffer(), np.int32) - p * DEALT
            total[at] += np.round(widened(np.frombuffer(change.as_buffer(), np.uint8), len(at)) * 2.0**32).astype(np.int64)
            many[at] += 1
    if part is not None:
        yield out()


def best_threshold(scores: np.ndarray, labels: np.ndarray, times: np.ndarray, default: float) -> float:
    """The cut with the best F1, halfway between the scores beside it; `default` with fewer than 5 rows of a class."""
    if min(times[labels == 1].sum(), times[labels == 0].sum()) < 5:
        return default
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(times[order] * (labels[order] == 1))
    f1 = 2 * hit / (np.cumsum(times[order]) + times[labels == 1].sum())
    f1[:-1][s[1:] == s[:-1]] = 0  # rows of one score stay together
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def train(rows: DataFrame, default: float) -> tuple[Net, float, float, dict[str, float]]:
    """The net, slope and offset of the logistic curve over its logits, and thresholds by language, from all labelled
    rows; the net learns from those that are not held back, the rest from those that are. Of the latter only the counts
    of logits in steps of one STEPth come to the driver."""
    forward = rows.where("not back")
    if forward.select("toxic").distinct().count() < 2:
        forward = rows
    net = taught(forward)
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 19):
                steps = np.round(np.clip(sent.value.logits(batch.column("text").to_pylist()), -60, 60) * STEP).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("lang"), pa.array(steps)], ["toxic", "lang", "step"])

    held = rows.where("back").select("toxic", "lang", "text").mapInArrow(run, "toxic int, lang string, step long")
    found = held.groupBy("toxic", "lang", "step").count().toArrow().sort_by([("lang", "ascending"), ("step", "ascending"), ("toxic", "ascending")])
    y, times, margin = found["toxic"].to_numpy(), found["count"].to_numpy().astype(float), found["step"].to_numpy() / STEP
    ones, share = times[y == 1].sum(), rows.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    zeros = times.sum() - ones
    weight = times * np.where(y == 1, share / max(1, ones), (1 - share) / max(1, zeros))
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    if ones and zeros:
        size = max(1e-6, float(np.abs(margin) @ times / times.sum()))
        m = margin / size
        for _ in range(3000):
            off = (1 / (1 + np.exp(-(a * m + b))) - target) * weight
            a, b = max(1e-3, a - 1.0 * (off @ m)), b - 1.0 * off.sum()
        a /= size
    scores = 1 / (1 + np.exp(-(a * margin + b)))
    langs = np.array(found["lang"].to_pylist(), object)
    cuts = {"": best_threshold(scores, y, times, default)} | {l: best_threshold(scores[langs == l], y[langs == l], times[langs == l], default) for l in sorted({*langs.tolist()} - {""})}
    return net, float(a), float(b), cuts


def score(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, default: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic 1 likelier), threshold and flagged (score reaches it) of every document.

    docs: doc_id, text and, if there is one, lang, by which only the threshold is chosen; labels: doc_id, toxic (0 or
    1); other columns are ignored. The net, the slope and the thresholds are learnt from all labelled documents, without those
    whose crc32 of the id modulo held_out[0] is held_out[1]; texts are read whole. A language with fewer than five
    labelled rows of each class held back has the threshold `default`, a language not met that of all rows. A null text
    counts as empty and has a score like any; a null doc_id stays; repeated rows are scored each; an empty table gives no
    rows. Without labels of both classes every score is the labels' mean (0 without any).
    """
    rows = labelled(docs, labels, held_out)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    classes = [r.toxic for r in rows.select("toxic").distinct().collect()]
    if len(classes) < 2:
        mean = float(classes[0]) if classes else 0.0
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(mean).alias("score"), F.lit(default).alias("threshold"), F.lit(mean >= default).alias("flagged"))
    net, a, b, cuts = train(rows, default)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for batch in pieces(whole, 1 << 19):
                logits = net.logits(batch.column("text").to_pylist())
                scores = np.round(1 / (1 + np.exp(-np.clip(a * logits + b, -700, 700))), 9)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    made = doc_bytes(docs, lang.alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")
    cut = F.lit(cuts.pop(""))
    for name, value in cuts.items():
        cut = F.when(F.col("lang") == name, value).otherwise(cut)
    return made.withColumn("threshold", cut).select("doc_id", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
