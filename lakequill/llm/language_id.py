"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a word, one from each end, and a softmax over both states labels
every byte; a document's probabilities are the mean over the bytes of its words. The network is trained in
numpy by backpropagation through time. Its state starts anew at each word, so a word's labels depend on the
word alone and each distinct word of a batch is run once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from lakequill.llm.text import doc_bytes, fold, pieces

#: Longer words are run in stretches of so many bytes.
STRETCH = 32
LETTERS = bytes([*range(65, 91), *range(97, 123)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """One input table, recurrent matrix for each direction, and an output layer."""

    def __init__(self, classes: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", rng.normal(0, 0.3, (256, 3 * hidden))), ("u", rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))))}
        self.p |= {"o": rng.normal(0, 0.1, (2 * hidden, classes)), "c": np.zeros((1, classes))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def layer(self, d: str, x: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States after each byte of one direction; x is (time, batch) and runs in that direction's order."""
        n, table, u = self.h, self.p["x" + d], self.p["u" + d]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t, now in enumerate(x):
            a, r = table[now], h @ u
            gate = sigmoid(a[:, : 2 * n] + r[:, : 2 * n])
            z, s = gate[:, :n], gate[:, n:]
            new = np.tanh(a[:, 2 * n :] + s * r[:, 2 * n :])
            old, h = h, new + z * (h - new)
            if mask is not None:
                h = np.where(mask[t][:, None], h, old)
            if keep is not None:
                keep.append((old, z, s, new, r[:, 2 * n :]))
            out[t] = h
        return out

    def label(self, x: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """Probabilities (time, batch, class) for byte columns x (time, batch)."""
        both = [self.layer("f", x, mask, keep and keep["f"]), self.layer("b", x[::-1], mask if mask is None else mask[::-1], keep and keep["b"])[::-1]]
        h = np.concatenate(both, 2)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(2, keepdims=True))
        if keep is not None:
            keep["h"] = h
        return z / z.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes, by backpropagation through time."""
        keep: dict = {"f": [None], "b": [None]}
        off = self.label(x, mask, keep)
        off[:, np.arange(len(y)), y] -= 1
        off *= mask[:, :, None] / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = np.einsum("tbh,tbc->hc", keep["h"], off), off.sum((0, 1))[None]
        back, n = off @ self.p["o"].T, self.h
        for d, part, cols, on in (("f", back[:, :, :n], x, mask), ("b", back[::-1, :, n:], x[::-1], mask[::-1])):
            u, dh = self.p["u" + d], np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                old, z, s, new, rn = keep[d][t + 1]
                dh = dh + part[t]
                stay = np.where(on[t][:, None], 0, dh)
                dh = dh - stay
                dn = dh * (1 - z) * (1 - new**2)
                da = np.concatenate([dh * (old - new) * z * (1 - z), dn * rn * s * (1 - s), dn], 1)
                dr = np.concatenate([da[:, : 2 * n], dn * s], 1)
                np.add.at(g["x" + d], cols[t], da)
                g["u" + d] += old.T @ dr
                dh = dh * z + dr @ u.T + stay
        return g


def train(words: list[bytes], labels: np.ndarray, classes: int, hidden: int = 16, steps: int = 500, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """A network fitted to words by Adam."""
    net, rng = Network(classes, hidden, seed), np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(words), batch)
        some = [words[i] for i in pick]
        size = max(map(len, some))
        x = np.zeros((size, batch), np.uint8)
        for j, w in enumerate(some):
            x[: len(w), j] = np.frombuffer(w, np.uint8)
        mask = np.arange(size)[:, None] < np.array([len(w) for w in some])
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradients(x, mask, labels[pick]).items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def stretches(word: bytes) -> list[bytes]:
    return [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]


class WordLabels:
    """Class probabilities summed over a word's bytes, for recent distinct words."""

    def __init__(self, net: Network, classes: int, room: int = 150_000):
        self.net, self.classes, self.room = net, classes, room
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, classes), np.float32)

    def run(self, words: list[bytes]) -> np.ndarray:
        """Sums for each word; words of one length go through the network together."""
        out = np.zeros((len(words), self.classes), np.float32)
        parts = [(len(s), i, s) for i, w in enumerate(words) for s in stretches(w)]
        parts.sort(key=lambda p: p[0])
        lengths = np.array([p[0] for p in parts])
        for n in np.unique(lengths):
            lo, hi = np.searchsorted(lengths, [n, n + 1])
            for at in range(lo, hi, 4096):
                some = parts[at : min(at + 4096, hi)]
                x = np.frombuffer(b"".join([s for _, _, s in some]), np.uint8).reshape(len(some), n).T
                np.add.at(out, [i for _, i, _ in some], self.net.label(x).sum(0))
        return out

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Rows of self.sums for the words."""
        if len(self.known) > self.room:
            self.known, self.sums = {}, self.sums[:0]
        missing = list(set(words).difference(self.known))
        if missing:
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
            self.sums = np.concatenate([self.sums, self.run(missing)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def has_letter(text: bytes) -> bool:
    return text.translate(None, LETTERS) != text or (not text.isascii() and regex.search(r"\p{L}", text.decode("utf-8", "replace")) is not None)


def drawn(text: bytes, most: int) -> list[bytes]:
    """At most so many words of a whole text, in order, drawn by a seed that the text gives."""
    words = text.lower().split()
    if len(words) <= most:
        return words
    return [words[i] for i in np.sort(np.random.default_rng(zlib.crc32(text)).choice(len(words), most, replace=False))]


def fit(docs: DataFrame, held_out: tuple[int, int] | None, per_language: int, per_text: int, hidden: int, steps: int) -> tuple[Network | None, list[str]]:
    """The network and its languages, from at most `per_language` documents of each language and
    `per_text` words of each, drawn from the whole text (a bounded sample of labelled rows; see predict)."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if held_out:
        rows = rows.where(fold("doc_id", held_out[0]) != held_out[1])
    order = Window.partitionBy("lang").orderBy(F.crc32(F.reverse(F.col("doc_id").cast("string"))), "doc_id")
    few = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n").distinct()
    got = sorted((r.lang, r.doc_id, bytes(r.text)) for r in doc_bytes(rows, "lang").join(F.broadcast(few), ["lang", "doc_id"]).toLocalIterator())
    languages = sorted({g[0] for g in got})
    words, labels = [], []
    for lang, _, text in got:
        for w in drawn(text, per_text):
            for s in stretches(w):
                words.append(s)
                labels.append(languages.index(lang))
    return (train(words, np.array(labels), len(languages), hidden, steps) if words else None), languages


def predict(docs: DataFrame, held_out: tuple[int, int] | None = None, per_language: int = 150, per_text: int = 300, hidden: int = 16, steps: int = 500) -> DataFrame:
    """doc_id, lang_pred and score (its pooled probability) of every document, over its whole text.

    docs: doc_id, text, lang; other columns are ignored, and lang only teaches. The network learns from at most
    `per_language` documents of each language and `per_text` words drawn from each of these, without those whose crc32 of the id modulo held_out[0] is
    held_out[1]. A text that is null or has no letter gets `und` and score 0, as does every text when there is
    nothing to learn from; equal probabilities go to the lesser code; a null doc_id stays null; repeated rows
    are judged each; an empty table gives no rows.
    """
    net, languages = fit(docs, held_out, per_language, per_text, hidden, steps)
    if net is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = WordLabels(net, len(languages))
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                split = [t.lower().split() for t in texts]
                rows = label([w for words in split for w in words])
                doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
                sums = np.stack([np.bincount(doc, label.sums[rows, c], len(split)) for c in range(len(languages))], 1)
                mean = sums / np.maximum(sums.sum(1, keepdims=True), 1e-9)
                best, clear = mean.argmax(1), [has_letter(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([languages[i] if ok else "und" for i, ok in zip(best, clear, strict=True)], pa.string()), pa.array([round(min(1.0, float(m[i])), 6) if ok else 0.0 for m, i, ok in zip(mean, best, clear, strict=True)], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return doc_bytes(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
