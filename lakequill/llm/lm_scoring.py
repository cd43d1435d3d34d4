"""Language-model scores by logistic context mixing, beside a unigram base.

A text is coded as binary decisions, each with a probability: for every word whether it is one of the common words; if
so, the bits of its place among them; if not, the bits of its bytes and of a space after them. The end is a common word.
Bit predictors give the share of ones that the training texts had in a context. For common words these are the bits so
far, alone and with the topic that the text's words before speak for (mixed first), and the bits so far after the word
before and after the two words before (exact counts, from the task that holds all that follows a word). For spelt words
they are the bits of the byte so far with the last 2 to 5 bytes (hashed to slots of fixed tables) and with the whole word
so far (exact counts, from the task that holds all words with its first bytes). Their log-odds are summed by weights,
which a gate picks; the result is refined by a table over the gate or the bits so far and the mixed log-odds. Weights and
table are learnt online from the training counts, each occurrence left out of its own counts; those of words' contexts
by each bucket of last words. In scoring the model stands still, so no order of documents matters.

Only distinct words are spelt: a table of all words outside the common ones, with counts and log-probabilities, is made
by Spark, grows with the corpus and meets the documents in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import SPACES, doc_bytes, fold, give_back, hashed_words, kept, mix64, pieces

#: Bits of a common word's place; there are so many common words at most, the end among them.
PLACE = 17
#: Bytes of the hashed contexts, slots of their tables and values of a hash, both as powers of two.
LENGTHS, BITS, HASHED = (2, 3, 4, 5), (17, 19, 20, 20), 16
ORDERS = len(LENGTHS)
#: First bytes that words of one task share, so that the counts after longer beginnings are whole there.
BEGIN = 5
TOPICS, TOPICAL, STEPS = 6, 256, 33
#: Training tokens that a bucket of last words has about and that a last word has in one bucket at most, the parts of a
#: score's 1 that sums are made of, and 0 (never) to 4 by how often a context was seen.
BUCKET, HOT, UNIT = 1 << 19, 1 << 18, 1 << 16
MET = np.searchsorted([1, 3, 15, 63], np.arange(64), side="right").astype(np.uint8)


def log_odds(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.2) / (seen - ones + 0.2))


def sureness(seen: np.ndarray) -> np.ndarray:
    """0 to 3 by how often a context was seen."""
    return (seen >= 3).astype(np.int64) + (seen >= 15) + (seen >= 63)


class Mixer:
    """Gated weights over the predictors' log-odds (and a constant), and the table that refines their sum."""

    def __init__(self, gates: int, inputs: int, rows: int, rate: float = 0.16):
        self.weights, self.rate = np.full((gates, inputs + 1), 1.0 / inputs, np.float32), rate
        self.weights[:, inputs] = 0
        self.used = np.zeros(gates)
        even = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS)))
        self.ones, self.seen = np.tile(20 * even, rows), np.full(rows * STEPS, 20.0)

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(x), np.result_type(x, self.weights))
        for column, w in zip(x.T, self.weights.T.copy(), strict=True):
            z += column * w[gate]
        return np.clip(z, -12, 12)

    def steps(self, row: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the step below, and the share of the step above."""
        at = (z + 12) * (STEPS - 1) / 24
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        return row * STEPS + low, at - low

    def probability(self, x: np.ndarray, gate: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of a one."""
        z = self.odds(x, gate)
        low, share = self.steps(row, z)
        refined = self.ones / self.seen
        return 0.5 / (1 + np.exp(-z)) + 0.5 * (refined[low] * (1 - share) + refined[low + 1] * share)

    def learn(self, x: np.ndarray, gate: np.ndarray, row: np.ndarray, one: np.ndarray, mass: np.ndarray) -> None:
        """One step of each gate towards the bits, weighed by mass; then the table counts them."""
        z, gates = self.odds(x, gate), len(self.weights)
        off = (one - 1 / (1 + np.exp(-z))) * mass
        total = np.bincount(gate, mass, gates)
        for j in range(x.shape[1]):
            self.weights[:, j] += (self.rate * np.bincount(gate, off * x[:, j], gates) / np.maximum(total, 50)).astype(np.float32)
        self.used += total
        low, share = self.steps(row, z)
        # the two steps' parts of zeros and ones
        both, above = (np.bincount(2 * low + one.astype(np.int64), x, 2 * len(self.seen)).reshape(-1, 2) for x in (mass, mass * share))
        for at, part in ((slice(None), both - above), (slice(1, None), above[:-1])):
            self.seen[at] += part.sum(1)
            self.ones[at] += part[:, 1]


class Places:
    """The place of each word, given by its hash, in a list of words."""

    def __init__(self, hashes: np.ndarray):
        self.count, self.order = len(hashes), np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.slot, self.shared = np.full(1 << 21, -1, np.int32), np.zeros(1 << 21, bool)
        at = (self.sorted & np.uint64(len(self.slot) - 1)).astype(np.int64)
        self.slot[at] = np.arange(self.count)
        self.shared[at[self.slot[at] != np.arange(self.count)]] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """-1 for words outside."""
        at = (h & np.uint64(len(self.slot) - 1)).astype(np.int64)
        found = self.slot[at]
        hit = np.flatnonzero(found >= 0)
        same = self.sorted[found[hit]] == h[hit]
        out = np.full(len(h), -1, np.int64)
        out[hit[same]] = self.order[found[hit[same]]]
        if len(rest := hit[~same & self.shared[at[hit]]]):
            near = np.minimum(np.searchsorted(self.sorted, h[rest]), self.count - 1)
            good = self.sorted[near] == h[rest]
            out[rest[good]] = self.order[near[good]]
        return out


def placed(part: pa.RecordBatch, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts in a row: hash and place (the end's is 0), and where each text's begin (one more entry)."""
    words, at = hashed_words(part.column("text").to_pylist())
    sizes = np.diff(at)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    end = np.zeros(begin[-1], bool)
    end[begin[1:] - 1] = True
    h, place = np.zeros(len(end), np.uint64), np.zeros(len(end), np.int64)
    h[~end] = words
    place[~end] = places(words)
    return h, place, begin


class Topics:
    """Which of TOPICS clusters a text's words so far speak for; the TOPICAL commonest words alone count."""

    def __init__(self, n: np.ndarray):
        """n: how often the texts of each cluster have each topical word."""
        self.table = np.zeros((n.shape[1] + 1, TOPICS), np.float32)
        if n.sum() > 0:
            share = n + 0.05 * (n.sum(0) / n.sum()) * n.shape[1] + 1e-3
            logs = np.log(share / share.sum(1, keepdims=True)).T
            self.table[:-1] = np.round(logs - logs.mean(1, keepdims=True), 6)

    def before(self, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The topic before each token; place and begin as placed() gives them."""
        at = np.flatnonzero((place >= 1) & (place < len(self.table)))  # no other word moves the sums
        run = np.zeros((len(at) + 1, TOPICS))
        np.cumsum(self.table[place[at] - 1], 0, out=run[1:], dtype=np.float64)
        first = np.searchsorted(at, begin)
        sizes = np.diff(first)
        # of each text: before any such word, then after each
        rows = np.arange(len(at) + len(sizes)) - np.repeat(np.arange(len(sizes)), sizes + 1)
        best = (run[rows] - np.repeat(run[first[:-1]], sizes + 1, 0)).argmax(1)
        lasts = np.concatenate((begin[:-1], at + 1))
        # the word itself is not before itself, and a text ends with its end, which is none
        turn = np.argsort(lasts, kind="stable")
        return np.repeat(best, np.diff(np.append(lasts[turn], begin[-1])))


def bags(train: DataFrame, places: Broadcast) -> DataFrame:
    """How often each text has the topical words, many texts a row: sizes (of texts with such words), word and n, as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                _, place, begin = placed(part, places.value)
                text = np.repeat(np.arange(part.num_rows), np.diff(begin))
                some = (place >= 1) & (place <= TOPICAL)
                pair, n = np.unique(text[some] * TOPICAL + place[some] - 1, return_counts=True)
                if len(pair):
                    sizes = np.bincount(pair // TOPICAL)
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (sizes[sizes > 0], pair % TOPICAL, n)], ["sizes", "word", "n"])

    return train.select("text").mapInArrow(run, "sizes binary, word binary, n binary")


def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one row of bags(): where texts begin, the words, how often, and each word's part of its text's direction."""
    sizes, word, n = (np.frombuffer(x, np.int32) for x in row)
    starts = np.cumsum(sizes) - sizes
    return starts, word, n, np.sqrt(n / np.repeat(np.add.reduceat(n, starts), sizes))


def likeness(starts: np.ndarray, word: np.ndarray, x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Of each text with each cluster; rounded, so that no order of sums matters."""
    return np.round(np.add.reduceat(x[:, None] * middle.T[word], starts), 9)


def next_middle(texts: DataFrame, middle: np.ndarray) -> np.ndarray | None:
    """The direction of one more text: of the one with the most topical words at first, then of one drawn by a hash
    of its words, by its squared distance from the nearest of `middle`. The same for any order of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: tuple | None = None
        for b in batches:
            for row in zip(b["sizes"], b["word"], b["n"], strict=True):
                starts, word, n, x = unpacked(row)
                name = np.add.reduceat(mix64(word.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)), starts)
                if len(middle):
                    far = np.maximum(1 - likeness(starts, word, x, middle).max(1), 0)
                    u = ((mix64(name + np.uint64(len(middle))) >> np.uint64(11)) + 0.5) / 2.0**53
                    order = np.log(u) / np.maximum(far, 1e-9)
                else:
                    order = np.add.reduceat(n, starts).astype(float)
                name = name.astype(np.int64)
                i = np.lexsort((name, order))[-1]
                if best is None or (order[i], name[i]) > best[:2]:
                    stop = starts[i + 1] if i + 1 < len(starts) else len(word)
                    best = order[i], name[i], word[starts[i] : stop].tobytes(), n[starts[i] : stop].tobytes()
        if best:
            yield pd.DataFrame([best], columns=["by", "name", "word", "n"])

    found = texts.mapInPandas(run, "by double, name long, word binary, n binary").orderBy(F.desc("by"), F.desc("name")).first()
    if found is None:
        return None
    word, n = np.frombuffer(found.word, np.int32), np.frombuffer(found.n, np.int32)
    out = np.zeros(TOPICAL)
    out[word] = np.sqrt(n / n.sum())
    return out


def clustered(train: DataFrame, places: Broadcast, rounds: int = 4) -> Topics:
    """Clusters of all texts by their topical words (spherical k-means from texts far apart). Directions are summed
    as whole numbers, so no order of rows or tasks changes them."""
    texts = kept(bags(train, places))
    middle, n = np.zeros((0, TOPICAL)), np.zeros((TOPICS, TOPICAL))
    while len(middle) < TOPICS:
        one = next_middle(texts, middle)
        if one is None:
            return Topics(n)
        middle = np.vstack([middle, one])
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], now: np.ndarray = middle) -> Iterator[pd.DataFrame]:
            way, count = np.zeros(TOPICS * TOPICAL, np.int64), np.zeros(TOPICS * TOPICAL, np.int64)
            for b in batches:
                for row in zip(b["sizes"], b["word"], b["n"], strict=True):
                    starts, word, n, x = unpacked(row)
                    own = likeness(starts, word, x, now).argmax(1)
                    at = np.repeat(own, np.diff(np.append(starts, len(word)))) * TOPICAL + word
                    way += np.bincount(at, np.round(x * 2.0**24), len(way)).astype(np.int64)
                    count += np.bincount(at, n, len(way)).astype(np.int64)
            at = np.flatnonzero(count)
            yield pd.DataFrame({"i": at, "way": way[at], "n": count[at]})

        sums, n = np.zeros(TOPICS * TOPICAL), np.zeros(TOPICS * TOPICAL)
        for r in texts.mapInPandas(run, "i long, way long, n long").groupBy("i").agg(F.sum("way").alias("way"), F.sum("n").alias("n")).collect():
            sums[r.i], n[r.i] = r.way, r.n
        sums, n = sums.reshape(middle.shape), n.reshape(middle.shape)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        before, middle = middle, np.where(size > 0, sums / np.maximum(size, 1e-9), middle)
        if np.array_equal(before, middle):
            break
    return Topics(n)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, n long) of all words: how often in training texts (0: in others alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()
        for batch in batches:
            for text, learns in zip(batch.column("text"), batch.column("learns").to_pylist(), strict=True):
                seen[learns].update(text.as_buffer().to_pybytes().lower().split())
            for learns, words in enumerate(seen):
                if len(words) > 300_000:
                    yield table(words, learns)
                    words.clear()
        for learns, words in enumerate(seen):
            yield table(words, learns)

    def table(words: Counter[bytes], learns: int) -> pa.RecordBatch:
        n = np.fromiter(words.values(), np.int64, len(words)) * learns
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(n)], ["word", "n"])

    return rows.select("text", "learns").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def place_counts(train: DataFrame, places: Broadcast, topics: Broadcast, common: int) -> np.ndarray:
    """How often the tokens of training texts have each topic before them and each place; the last place is that of
    all words outside."""
    width = common + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TOPICS * width, np.int64)
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                _, place, begin = placed(part, places.value)
                topic = topics.value.before(place, begin)
                n += np.bincount(topic * width + np.where(place < 0, common, place), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["i", "n"])

    found = train.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most TOPICS * width rows
    out = np.zeros(TOPICS * width)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(TOPICS, width)


def common_odds(counts: np.ndarray, batch: int = 4096) -> list[np.ndarray]:
    """Log-odds after each topic that a word is spelt, then those of each bit of a place after the bits before it; counts
    as place_counts() gives them."""
    common = counts.shape[1] - 1
    whole = np.zeros((TOPICS, 1 << PLACE))
    whole[:, :common] = counts[:, :common]
    levels = [whole.reshape(TOPICS, 1 << j, -1).sum(2) for j in range(PLACE + 1)]  # how often each beginning of j bits
    tables = [(np.stack([counts[:, -1]], 1), np.stack([counts.sum(1)], 1))] + [(levels[j + 1][:, 1::2], levels[j]) for j in range(PLACE)]
    every = [(ones.sum(0), seen.sum(0)) for ones, seen in tables]
    mixer = Mixer((PLACE + 1) * 4, 2, PLACE + 1)

    def inputs(j: int, topic: np.ndarray, node: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, ...]:
        (ones, seen), (all_ones, all_seen) = tables[j], every[j]
        a, b, c, d = all_ones[node], all_seen[node], ones[topic, node], seen[topic, node]
        if own is not None:  # the occurrence itself is left out
            a, b, c, d = np.maximum(a - own, 0), np.maximum(b - 1, 0), np.maximum(c - own, 0), np.maximum(d - 1, 0)
        x = np.stack([log_odds(np.minimum(a, b), b), log_odds(np.minimum(c, d), d), np.full(len(a), 0.3)], 1)
        return x, j * 4 + sureness(d), np.full(len(a), j)

    topic, place = np.nonzero(counts)
    turn = np.argsort(mix64((topic * counts.shape[1] + place).astype(np.uint64)), kind="stable")
    for at in range(0, len(turn), batch):
        t, p = topic[turn[at : at + batch]], place[turn[at : at + batch]]
        mass = counts[t, p] ** 0.75
        mixer.learn(*inputs(0, t, np.zeros(len(p), np.int64), (p == common) * 1.0), (p == common) * 1.0, mass)
        t, p, mass = t[p < common], p[p < common], mass[p < common]
        for j in range(PLACE):
            one = (p >> (PLACE - 1 - j) & 1) * 1.0
            mixer.learn(*inputs(j + 1, t, p >> (PLACE - j), one), one, mass)
    out = []
    for j in range(PLACE + 1):
        node = np.arange(max(1, 1 << j >> 1))
        p = [mixer.probability(*inputs(j, np.full(len(node), t), node, None)) for t in range(TOPICS)]
        out.append(np.log(np.stack(p) / (1 - np.stack(p))))
    return out


def common_scores(counts: np.ndarray, odds: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 of the probability of each place after each topic, whatever word is before it; counts as place_counts() gives
    them, odds: their common_odds(), where they are at hand."""
    odds, common = odds or common_odds(counts), counts.shape[1] - 1
    out, place = np.zeros((TOPICS, common + 1)), np.arange(common)
    out[:, common] = log10_of(odds[0][:, 0])
    out[:, :common] = log10_of(-odds[0])
    for j in range(PLACE):
        one = place >> (PLACE - 1 - j) & 1
        out[:, :common] += log10_of(odds[j + 1][:, place >> (PLACE - j)] * (2 * one - 1))
    return out


def log10_of(odds: np.ndarray) -> np.ndarray:
    """log10 of the probability that has these log-odds."""
    return -np.logaddexp(0, -odds) / np.log(10)


def stored(columns: list[np.ndarray]) -> bytes:
    """Columns of as many numbers each, byte by byte, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), codec="zstd", asbytes=True)


def restored(data: bytes, n: int, kinds: str) -> list[np.ndarray]:
    """The columns of n numbers each; kinds as numpy names them."""
    sizes = [n * np.dtype(k).itemsize for k in kinds.split()]
    raw = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(part.reshape(-1, n).T).view(k).ravel() for k, part in zip(kinds.split(), np.split(raw, np.cumsum(sizes)[:-1]), strict=True)]


def behind(x: np.ndarray) -> np.ndarray:
    """What stands one token back; 0, as for an end, before the first."""
    return np.concatenate((np.zeros(1, x.dtype), x[:-1]))


def dealt(rows: DataFrame, places: Broadcast, topics: Broadcast, seen: Broadcast, buckets: int) -> DataFrame:
    """All tokens, dealt by the word before them, so that all that follows a word stands in one bucket; after a word with
    more than HOT training tokens, all that follows the same two words (after an end: all of one text). A row has the tokens
    that a piece of the texts (`batch`) has in a bucket: the text of each, the words before it and before that, its place,
    its topic and whether it teaches. One more row of each piece has the names of its texts."""
    last = len(seen.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = (seen.value // HOT + 1).astype(np.uint64)
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                h, place, begin = placed(part, places.value)
                text = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(begin))
                name = part.column("name").to_numpy().view(np.uint64)
                flag = (topics.value.before(place, begin) << 1 | part.column("learns").to_numpy(zero_copy_only=False)[text]).astype(np.uint8)
                h = np.where(place < 0, h, place.astype(np.uint64))
                word = np.where(place < 0, h >> np.uint64(41) | np.uint64(1 << 23), h).astype(np.uint32)
                before, further = behind(word), behind(behind(word))
                further[begin[:-1]] = 0
                near, spread = behind(place), behind(h)
                hot = np.flatnonzero((near >= 0) & (ways[near] > 1))
                spread[hot] += mix64(np.where(near[hot] == 0, name[text[hot]], further[hot].astype(np.uint64))) % ways[near[hot]] << np.uint64(32)
                bucket = (mix64(spread) % np.uint64(buckets)).astype(np.int64)
                turn = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                columns = [x[turn] for x in (text, before, further, np.where(place < 0, last, place).astype(np.uint32), flag)]
                n = np.bincount(bucket)
                some = np.flatnonzero(n)
                blobs = []
                for stop, size in zip(np.cumsum(n)[some].tolist(), n[some].tolist(), strict=True):
                    of, *others = (x[stop - size : stop] for x in columns)
                    blobs.append(stored([np.diff(of, prepend=np.uint32(0)), *others]))
                piece = int(mix64(np.cumsum(mix64(name))).sum().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*some, piece % buckets], pa.int32()), pa.array([piece] * (len(some) + 1)), pa.array([*n[some], len(name)], pa.int32()), pa.array([*blobs, name.tobytes()]), pa.array([False] * len(some) + [True])],
                    ["bucket", "batch", "n", "data", "names"],
                )

    return rows.select("text", "learns", "name").mapInArrow(run, "bucket int, batch long, n int, data binary, names boolean")


class Followers:
    """Counts after contexts, bit by bit: keys that end in a code whose bits are asked one after the other from the first,
    how often training texts have each, and the order that sorts them. Keys alone with the bits so far need no sums."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: np.ndarray):
        self.key, self.n, self.crowd = key, n, order
        # what a key says that is alone, and that but for one occurrence
        self.alone = [self.said(x, x) for x in (n, np.maximum(n - 1, 0))]

    def only(self, keep: np.ndarray) -> Followers:
        return Followers(self.key[keep], self.n[keep], (np.cumsum(keep) - 1)[self.crowd[keep[self.crowd]]])

    @staticmethod
    def said(ones: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of contexts, and 0 (never) to 4 by how often each was seen."""
        return np.log((ones + np.float32(0.2)) / (seen - ones + np.float32(0.2))), MET[np.minimum(seen, 63).astype(np.uint8)]

    def bit(self, shift: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Each key's bit and, after the bits before it, what the counts say: all, and without one occurrence of the key."""
        one = (self.key >> np.uint64(shift) & np.uint64(1)).astype(np.float32)
        sign = 2 * one - 1
        out = [(sign * x, met.copy()) for x, met in self.alone]
        group = self.key[self.crowd] >> np.uint64(shift + 1)
        edges = np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(1, len(group)), bool), group[1:] != group[:-1]))), [len(group)]))
        sizes = np.diff(edges)
        self.crowd = self.crowd[np.repeat(sizes > 1, sizes)]
        if len(self.crowd):
            sizes = sizes[sizes > 1]
            starts, n, own = np.cumsum(sizes) - sizes, self.n[self.crowd], one[self.crowd]
            ones, seen = (np.repeat(np.add.reduceat(x, starts), sizes) for x in (n * own, n))
            for (x, met), less in zip(out, (np.float32(0), np.float32(1)), strict=True):
                x[self.crowd], met[self.crowd] = self.said(np.clip(ones - less * own, 0, np.maximum(seen - less, 0)), np.maximum(seen - less, 0))
        return one, out


def context_scores(before: np.ndarray, further: np.ndarray, on: np.ndarray, topic: np.ndarray, learns: np.ndarray, odds: list[np.ndarray], alone: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's place (the last: it is spelt) after the word before it, the word before
    that and its topic. For each bit three log-odds are mixed: those of the topic (odds, as common_odds() gives them) and
    of the counts after the word before and after both. Weights are learnt from the tokens that teach, each left out of its
    own counts. A bit that neither count has seen follows the topic alone, and so does (by alone, as common_scores() gives
    it) a token after a word that no training text has."""
    common, low = alone.shape[1] - 1, np.uint64((1 << PLACE + 4) - 1)
    code = np.where(on == common, 1 << PLACE, on).astype(np.uint64)
    # contexts by 43 bits of a hash, above the code and the topic
    key = mix64(before.astype(np.uint64) << np.uint64(32) | further) & ~low | code << np.uint64(3) | topic.astype(np.uint64)
    turn = np.argsort(key)
    key = key[turn]
    new = np.concatenate((np.ones(1, bool), key[1:] != key[:-1]))
    key, first, back = key[new], turn[new], np.empty(len(turn), np.int64)
    back[turn] = np.cumsum(new) - 1
    near = mix64(before[first].astype(np.uint64)) & ~low | code[first]
    turn = np.argsort(near, kind="stable")  # by the word before, so that its counts are met in order
    key, near, first, n = key[turn], near[turn], first[turn], np.bincount(back, learns, len(key)).astype(np.float32)[turn]
    order = np.empty(len(turn), np.int64)
    order[turn] = np.arange(len(turn))
    back = order[back]
    new = np.concatenate((np.ones(1, bool), near[1:] != near[:-1]))
    near, of = near[new], np.cumsum(new) - 1
    near_n = np.bincount(of, n).astype(np.float32)
    place, told = on[first].astype(np.int64), topic[first].astype(np.int64)
    context = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(near & ~low) > 0)))
    out = alone[told, place].astype(np.float64)
    taught_before = (np.bincount(context, near_n) > 0)[context[of]]
    chance = np.ones(len(out))  # at least 1e-6 for each bit, so that no product vanishes
    after, both, some = Followers(near, near_n, np.arange(len(near))), Followers(key, n, order), np.arange(len(key))
    del code, key, near, first, turn, order, new
    for j in range(PLACE + 1):
        shift = PLACE - j
        if j < 2:  # whether a word is spelt; then the bits of places, which spelt words lack
            keep = place < common if j else taught_before
            both, of, place, told, some = both.only(keep), of[keep], place[keep], told[keep], some[keep]
            taught, mass = np.flatnonzero(both.n), both.n**0.75
        one, ((x2, met2), (less2, met_less2)) = both.bit(shift + 3)
        _, ((x, met), (less, met_less)) = after.bit(shift)
        z = odds[j][told, place >> shift + 1 if j else 0]
        mixer, gate = Mixer(25, 3, 25), (5 * met_less)[of] + met_less2
        mixer.weights[:] = 1, 0, 0, 0
        taught = taught[gate[taught] > 0]  # longer beginnings are seen no more often
        start, size = 0, 256
        while start < len(taught):
            i = taught[start : start + size]
            inputs, gates = np.stack([z[i], less[of[i]], less2[i], np.full(len(i), 0.3, np.float32)]).T, gate[i].astype(np.int64)
            mixer.learn(inputs, gates, gates, one[i], mass[i])
            start, size = start + size, min(2 * size, 1 << 14)
        gate = (5 * met)[of] + met2
        for start in range(0, len(some), 1 << 14):
            i = slice(start, start + (1 << 14))
            inputs, gates = np.stack([z[i], x[of[i]], x2[i], np.full(len(z[i]), 0.3, np.float32)]).T, gate[i].astype(np.int64)
            p = mixer.probability(inputs, gates, gates)
            unmet = np.flatnonzero(gates == 0)
            p[unmet] = 1 / (1 + np.exp(-z[i][unmet].astype(np.float64)))
            chance[some[i]] *= np.abs(p - (1 - one[i]))
    out[taught_before] = np.log10(chance[taught_before])
    return out[back]


def bucket_rows(rows: list[tuple[int, int, bytes]], odds: list[np.ndarray], alone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of each piece in a bucket: its texts there and their scores, in units of 1 / UNIT, so that no order of sums matters."""
    parts = [restored(data, n, "u4 u4 u4 u4 u1") for _, n, data in rows]
    before, further, on, flag = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    texts = [np.cumsum(p[0], dtype=np.uint32) for p in parts]
    del parts
    score = np.round(context_scores(before, further, on, flag >> 1, flag & 1, odds, alone) * -UNIT).astype(np.int64)
    stop = 0
    for (piece, n, _), text in zip(rows, texts, strict=True):
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), text[1:] != text[:-1])))
        sums = np.add.reduceat(score[stop : stop + n], starts)
        stop += n
        yield piece, len(starts), stored([np.diff(text[starts], prepend=np.uint32(0)), sums])


def in_contexts(tokens: DataFrame, tables: Broadcast, buckets: int) -> DataFrame:
    """(name, score): log10 of the probability of the places in each text of dealt(), one row a name."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = pa.schema({"batch": pa.int64(), "n": pa.int32(), "data": pa.binary(), "names": pa.bool_()})

    def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0][by] != row[by]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, "bucket"):
            named = [(r["batch"], r["n"], r["data"], True) for r in held if r["names"]]
            rows = [(r["batch"], r["n"], r["data"]) for r in held if not r["names"]]
            done = [(*row, False) for row in bucket_rows(rows, *tables.value)] if rows else []
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*named, *done), packed.types, strict=True)], schema=packed)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, "batch"):
            names = [np.frombuffer(r["data"], np.int64) for r in held if r["names"]]
            sums = np.zeros(len(names[0]), np.int64)
            for r in held:
                if not r["names"]:
                    text, score = restored(r["data"], r["n"], "u4 i8")
                    sums[np.cumsum(text)] += score
            yield pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(sums), pa.array([len(names)] * len(sums))], ["name", "score", "copies"])

    met = tokens.repartitionById(max(parts, buckets), F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(judge, "batch long, n int, data binary, names boolean")
    whole = met.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(add, "name long, score long, copies long")
    # equal rows have one name and equal scores
    return whole.groupBy("name").agg((F.sum("score") / F.sum("copies") / -UNIT).alias("score"))


class Spelling:
    """The bytes of words (a space after each), what stands before each byte and the counts that predict it."""

    def __init__(self, words: list[bytes]):
        data = b" ".join([*words, b""])
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.byte = np.frombuffer(data, np.uint8).astype(np.uint64)
        begin = np.cumsum(self.sizes) - self.sizes
        self.into = np.arange(len(self.byte)) - begin[self.word]
        self.context = np.zeros((ORDERS, len(self.byte)), np.uint64)  # hashes of the last bytes, fewer near the beginning
        last = np.zeros(len(self.byte), np.uint64)
        for back in range(1, LENGTHS[-1] + 1):
            at = np.flatnonzero(self.into >= back)
            last[at] |= self.byte[at - back] + np.uint64(1) << np.uint64(9 * (back - 1))
            if back in LENGTHS:
                self.context[LENGTHS.index(back)] = mix64(last + np.uint64(back << 56)) >> np.uint64(64 - HASHED)
        # a hash of the whole beginning, so the same for all words that share it
        up = np.multiply.accumulate(np.full(int(self.sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(self.byte + np.uint64(1)) * up[self.into])))
        self.beginning = mix64(sums[:-1] - sums[begin][self.word] + self.into.astype(np.uint64))

    def slots(self, order: int, part: np.ndarray) -> np.ndarray:
        return slot_of(order, self.context[order], part)


def slot_of(order: int, context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return ((context << np.uint64(8) | part) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS[order])).astype(np.int64)


def grams(tail: DataFrame) -> pa.Table:
    """(g, n): order, hashed context and byte of all spelt training words, and how often. Its rows are bounded by the
    hashed contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([n for _, n in held]))

        for batch in batches:
            batch = batch.filter(pa.array(batch.column("n").to_numpy() > 0))
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                s = Spelling(part.column("word").to_pylist())
                n = part.column("n").to_numpy().astype(float)[s.word]
                for order in range(ORDERS):
                    key, back = np.unique(np.uint64(order << 24) | s.context[order] << np.uint64(8) | s.byte, return_inverse=True)
                    held.append((key, np.bincount(back, n)))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    held = [summed()]
        if held:
            key, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    return tail.select("word", "n").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()


def slot_tables(found: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ones and all of each order's slots."""
    g, n = found["g"].to_numpy().astype(np.uint64), found["n"].to_numpy().astype(float)
    out = []
    for order in range(ORDERS):
        some = g >> np.uint64(24) == order
        context, byte, times = (g[some] >> np.uint64(8)) & np.uint64((1 << HASHED) - 1), g[some] & np.uint64(255), n[some]
        ones, seen = np.zeros(1 << BITS[order]), np.zeros(1 << BITS[order])
        for bit in range(8):
            slot = slot_of(order, context, (byte | np.uint64(256)) >> np.uint64(8 - bit))
            seen += np.bincount(slot, times, len(seen))
            ones += np.bincount(slot, times * ((byte >> np.uint64(7 - bit)) & np.uint64(1)), len(ones))
        out.append((ones.astype(np.float32), seen.astype(np.float32)))
    return out


def readings(tables: list[tuple[np.ndarray, np.ndarray]], without: bool) -> list[np.ndarray]:
    """What each order's slots say, so that all that is asked of one stands in one place: the log-odds as a float and, above
    it, 4 more than sureness() (0: never seen). without: of each slot for a zero and for a one, which is left out."""
    out = []
    for ones, seen in tables:
        if without:
            ones, seen = np.stack([ones, ones - 1], 1).ravel(), np.repeat(np.maximum(seen - 1, 0), 2)
        ones = np.minimum(np.maximum(ones, 0), seen)
        x = np.log((ones + np.float32(0.2)) / (seen - ones + np.float32(0.2))).astype("<f4")
        out.append(np.stack([x.view("<u4"), (4 * (seen > 0).astype(np.uint8) + (seen >= 3) + (seen >= 15) + (seen >= 63)).astype("<u4")], 1).ravel().view("<u8"))
    return out


def predicted(s: Spelling, n: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], without: bool, read: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of a byte's bits over all bytes: log-odds, gate, row of the refinement and whether the bit is one.
    n: how often training texts have each word; without: one occurrence of each word, all of which they have, is left out
    of the counts; read: readings() of the tables, where they are at hand."""
    read = readings(tables, without) if read is None else read
    times = n[s.word].astype(np.float32)
    own = np.float32(without)
    # the whole beginning, where it is longer than BEGIN; one that a single word has counts that word alone
    deep = np.flatnonzero(s.into >= BEGIN)
    _, group, size = np.unique(s.beginning[deep], return_inverse=True, return_counts=True)
    alone, shared = deep[size[group] == 1], deep[size[group] > 1]
    group = group[size[group] > 1]
    turn = np.lexsort((s.byte[shared], group))
    shared, group = shared[turn], group[turn]
    long = np.concatenate((alone, shared))
    seen = np.maximum(times[alone] - own, 0)
    for bit in range(8):
        part = (s.byte | np.uint64(256)) >> np.uint64(8 - bit)
        one = ((s.byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float32)
        x = np.zeros((ORDERS + 2, len(part)), np.float32).T  # a predictor's values in one run
        x[:, ORDERS + 1] = 0.3
        gate = np.zeros(len(part), np.int16)
        for order in range(ORDERS):
            slot = s.slots(order, part)
            said = read[order][slot << 1 | one.astype(np.int64) if without else slot]
            x[:, order] = said.view("<f4")[::2]
            sure = said.view(np.uint8)[4::8]
            gate = np.where(sure > 0, sure + np.int16(4 * order), gate)
        here = part[shared]
        new = np.ones(len(shared), bool)
        new[1:] = (group[1:] != group[:-1]) | (here[1:] != here[:-1])
        back = np.cumsum(new) - 1
        a, b = (np.bincount(back, w)[back] if len(back) else np.zeros(0) for w in (times[shared] * one[shared], times[shared]))
        b = np.concatenate((seen, np.maximum(b - own, 0)))
        a = np.minimum(np.concatenate((seen * one[alone], np.maximum(a - own * one[shared], 0))), b)
        x[long, ORDERS] = np.log((a + 0.2) / (b - a + 0.2))
        gate[long] = np.where(b > 0, 4 * (ORDERS + 1) + sureness(b), gate[long])
        yield x, bit * (ORDERS + 2) * 4 + gate.astype(np.int64), part.astype(np.int64), one


def spelt(batches: Iterator[pa.RecordBatch], most: int = 8_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Runs of about `most` sorted words that hold all words with their first BEGIN bytes."""
    words: list[bytes] = []
    n: list[int] = []
    for batch in batches:
        words += batch.column("word").to_pylist()
        n += batch.column("n").to_pylist()
        while len(words) > 2 * most:
            cut = most
            while cut < len(words) and words[cut][:BEGIN] == words[cut - 1][:BEGIN]:
                cut += 1
            if cut == len(words):
                break
            yield words[:cut], np.array(n[:cut], float)
            words, n = words[cut:], n[cut:]
    if words:
        yield words, np.array(n, float)


def spelling_mixer() -> Mixer:
    return Mixer(8 * (ORDERS + 2) * 4, ORDERS + 1, 256)


def learn(tail: DataFrame, tables: Broadcast, batch: int = 8192) -> Mixer:
    """The mixer of spelt words: each partition learns online over its training words; weights are averaged by mass, and
    the refinements' counts summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        mixer, read = spelling_mixer(), readings(tables.value, True)
        first = mixer.ones.copy(), mixer.seen.copy()
        for words, n in spelt(batches):
            turn = np.argsort(mix64(np.arange(len(n), dtype=np.uint64)), kind="stable")  # words in no order
            turn = turn[n[turn] > 0]
            s = Spelling([words[i] for i in turn])
            bits = [*predicted(s, n[turn], tables.value, True, read)]
            mass = (n[turn] ** 0.75)[s.word]
            for at in range(0, len(mass), batch):
                some = slice(at, at + batch)
                for x, gate, row, one in bits:
                    mixer.learn(x[some], gate[some], row[some], one[some], mass[some])
        values = np.concatenate([(mixer.weights * mixer.used[:, None]).ravel(), mixer.used, mixer.ones - first[0], mixer.seen - first[1]])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["i", "v"])

    mixer = spelling_mixer()
    size = mixer.weights.size
    values = np.zeros(size + len(mixer.used) + 2 * len(mixer.ones))
    found = tail.select("word", "n").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    values[found["i"].to_numpy()] = found["v"].to_numpy()
    weights, used, ones, seen = np.split(values, [size, size + len(mixer.used), len(values) - len(mixer.ones)])
    some = used > 0
    mixer.weights[some] = weights.reshape(mixer.weights.shape)[some] / used[some][:, None]
    mixer.used, mixer.ones, mixer.seen = used, mixer.ones + ones, mixer.seen + seen
    return mixer


def spelt_scores(tail: DataFrame, tables: Broadcast, mixer: Mixer) -> DataFrame:
    """(word long, a hash; n; score: log10 of the probability of its spelling) of all words outside the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = readings(tables.value, False)
        for words, n in spelt(batches):
            s = Spelling(words)
            total = np.zeros(len(words))
            for x, gate, row, one in predicted(s, n, tables.value, False, read):
                p = mixer.probability(x, gate, row)
                total += np.bincount(s.word, np.log10(np.where(one > 0, p, 1 - p)), len(words))
            yield pa.RecordBatch.from_arrays([pa.array(hashed_words(words)[0].astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], ["word", "n", "score"])

    return tail.select("word", "n").mapInArrow(run, "word long, n long, score double")


def score(docs: DataFrame, held_out: tuple[int, int], most: int = 1 << PLACE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    docs: doc_id, text; other columns are ignored. Texts whose crc32 of the id modulo held_out[0] is
    held_out[1] teach nothing. Tokens are words (A-Z in lower case) and one end. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens; score is the model's log10 probability of the text's words and its
    end, and bits_per_byte its bits over the bytes of the words, a space after each and the end. A null or empty text
    has its end alone; a null doc_id stays null, is not held out and teaches nothing; repeated rows are scored each and
    count each; an empty table gives no rows. With no training text all counts are 0. The commonest words of the
    training texts (less than `most`; of those that are as common all or none) are the common ones, if they come twice
    at least: words that come once are spelt, from which the model learns how often and how new words come. Common words
    go out with tasks, as the tables for spelling of a fixed size do; all tokens cross a shuffle by the word before them,
    whose scores come back by text; all other words' counts and scores meet their documents in a join. No text outside the training texts moves the score of another.
    """
    spark = docs.sparkSession
    rows = doc_bytes(docs).withColumn("held_out", F.coalesce(fold("doc_id", held_out[0]) == held_out[1], F.lit(False))).withColumn("learns", F.col("doc_id").isNotNull() & ~F.col("held_out")).withColumn("name", F.xxhash64("doc_id", "text"))
    train = rows.where("learns")
    words = kept(word_counts(rows))
    known = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("words")).first()
    texts = train.select("learns").count()
    train_tokens, vocabulary = known.n + texts, known.words + (texts > 0)
    often = words.where(F.col("n") > 1).groupBy("n").count().toArrow().sort_by([("n", "descending")]).to_pandas()
    fits = often["n"][often["count"].cumsum() < most]
    commonest = F.col("n") >= (int(fits.iloc[-1]) if len(fits) else known.n + 1)
    top = words.where(commonest).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    hashes = hashed_words(top["word"].to_pylist())[0]
    # place 0 is the end's; no word has its hash
    places = spark.sparkContext.broadcast(Places(np.concatenate((np.zeros(1, np.uint64), hashes))))
    topics = spark.sparkContext.broadcast(clustered(train, places))
    counts = place_counts(train, places, topics, top.num_rows + 1)
    odds = common_odds(counts)
    logs = spark.sparkContext.broadcast(([x.astype(np.float32) for x in odds], common_scores(counts, odds).astype(np.float32)))
    seen = spark.sparkContext.broadcast(np.concatenate(([texts], top["n"].to_numpy())))
    tail, parts = words.where(~commonest), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda some: kept(some.repartition(parts, F.substring("word", 1, BEGIN)).sortWithinPartitions("word"))
    taught = spread(tail.where("n > 0"))  # apart, so that no word of other texts moves where partitions and batches end
    tables = spark.sparkContext.broadcast(slot_tables(grams(taught)))
    rare = kept(spelt_scores(spread(tail), tables, learn(taught, tables)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = seen.value
        base_of, known_of, last = np.log10(n + 1.0), (n > 0).astype(np.int64), len(n)
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                h, place, begin = placed(part, places.value)
                on = np.where(place < 0, last, place)
                sums = [np.add.reduceat(x, begin[:-1]) for x in (np.append(base_of, 0.0)[on], np.append(known_of, 0)[on])]
                text = np.repeat(np.arange(part.num_rows), np.diff(begin))
                out = np.flatnonzero(place < 0)
                # the distinct words outside, of one text after the other
                order = np.lexsort((h[out], text[out]))
                key, doc = h[out][order], text[out][order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(key)))
                lists = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=part.num_rows)))).astype(np.int32))
                size = np.diff(begin) + [len(t.as_buffer().to_pybytes().translate(None, SPACES)) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("name"), pa.array(np.diff(begin)), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(lists, pa.array(key[first].astype(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                    ["doc_id", "held_out", "name", "n_tokens", "size", "base", "hits", "rare", "times"],
                )

    schema = "doc_id long, held_out boolean, name long, n_tokens long, size long, base double, hits long, rare array<long>, times array<int>"
    scored = kept(rows.select("doc_id", "text", "held_out", "name").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    tail_of = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    held = tail_of.join(rare, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("hits"), F.sum(F.col("times") * F.col("score")).alias("score"))
    buckets = -(-train_tokens // BUCKET) or 1
    placed_scores = in_contexts(dealt(rows, places, topics, seen, buckets), logs, buckets).withColumnRenamed("score", "placed")
    plain = scored.select("row", "doc_id", "held_out", "name", "n_tokens", "size", F.lit(0.0).alias("score"), "base", "hits")
    parts = held.selectExpr("row", "cast(null as long) doc_id", "cast(null as boolean) held_out", "cast(null as long) name", "0L n_tokens", "0L size", "score", "base", "hits")
    whole = plain.union(parts).groupBy("row").agg(*[F.max(x).alias(x) for x in ("doc_id", "held_out", "name")], *[F.sum(x).alias(x) for x in ("n_tokens", "size", "score", "base", "hits")])
    whole = whole.join(kept(placed_scores), "name", "left").withColumn("score", F.col("score") + F.col("placed"))
    total = float(np.log10(train_tokens + vocabulary + 1))
    return whole.select("doc_id", "held_out", "n_tokens", F.col("hits").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * total).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"))
