"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss
model fitted by dual coordinate descent; a logistic curve over held-back margins turns them into scores.

Features are a text's distinct character 3-grams (of UTF-8 bytes), hashed to a fixed number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import doc_bytes, fold, with_bytes

BITS = 16
#: Classes of size, each a column of its own.
SIZES = 24


def columns(text: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed byte 3-grams of a text, with a space before and after it, and its size's power of two."""
    size = min(len(text).bit_length(), SIZES - 1)
    b = np.frombuffer(b" %b " % text, np.uint8).astype(np.uint32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) if len(b) > 2 else np.zeros(0, np.uint32)
    if len(h) > 1 << (bits - 2):
        hit = np.zeros(1 << bits, bool)
        hit[h] = True
        h = np.flatnonzero(hit)
    else:
        h = np.unique(h)
    return np.append(h.astype(np.int64), (1 << bits) + size)


def fit(texts: list[bytes], labels: list[int], share: float, bits: int = BITS, c: float = 10.0, rounds: int = 10) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Weights by column with the bias last, slope and offset of the logistic curve, and the log-count ratios.
    share: of label 1 among all labelled texts, of which these are a sample by class."""
    x, y = [columns(t, bits) for t in texts], np.array(labels)
    counts = [np.bincount(np.concatenate([a for a, v in zip(x, y, strict=True) if v == k] or [np.zeros(0, int)]), minlength=(1 << bits) + SIZES) + 1.0 for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rng, sign = np.random.default_rng(7), np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, c * len(y) / max(1, 2 * (y == 1).sum()), c * len(y) / max(1, 2 * (y == 0).sum()))
    square = ratio**2
    unit = [1 / np.sqrt(square[a].sum() + 1e-9) for a in x]  # so that each row has length 1

    def descend(rows: np.ndarray) -> np.ndarray:
        """Weights over the ratios, from dual coordinate descent on these rows; the bias is a constant feature."""
        w, bias, dual = np.zeros((1 << bits) + SIZES), 0.0, np.zeros(len(y))
        for _ in range(rounds):
            for i in rng.permutation(rows):
                a, s = x[i], unit[i]
                r = ratio[a] * s
                slope = sign[i] * (w[a] @ r + bias) - 1
                new = min(max(dual[i] - slope / (r @ r + 1), 0), cost[i])
                if new != dual[i]:
                    w[a] += (step := (new - dual[i]) * sign[i]) * r
                    bias += step
                    dual[i] = new
        return np.append(w * ratio, bias)

    folds, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        w = descend(np.flatnonzero(folds != k))
        for i in np.flatnonzero(folds == k):
            margin[i] = w[x[i]].sum() * unit[i] + w[-1]
    a, b = 1.0, 0.0
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(300):
        off = 1 / (1 + np.exp(-(a * margin + b))) - target
        a, b = a - 2.0 * (off @ margin) / len(y), b - 2.0 * off.mean()
    b += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return descend(np.arange(len(y))), float(a), float(b), ratio


def sample(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None, most: int) -> tuple[list[bytes], list[int], float]:
    """At most `most` labelled texts of each class outside the held-out fold, those of least crc32 of the id,
    and the share of label 1 among all."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    order = [F.crc32(F.reverse(F.col("doc_id").cast("string"))), "doc_id", "quality"]
    known = known.distinct()
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    few = known.where("quality = 0").orderBy(*order).limit(most).union(known.where("quality = 1").orderBy(*order).limit(most))
    rows = sorted(((r.doc_id, r.quality, bytes(r.text)) for r in doc_bytes(docs).join(F.broadcast(few), "doc_id").toLocalIterator()))
    return [r[2] for r in rows], [r[1] for r in rows], n.get(1, 0) / max(1, sum(n.values()))


def margin_of(text: bytes, w: np.ndarray, square: np.ndarray, bits: int) -> float:
    c = columns(text, bits)
    return w[c].sum() / np.sqrt(square[c].sum() + 1e-9) + w[-1]


def score(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, most: int = 1500, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier) of every document, over its whole text.

    docs: doc_id, text; labels: doc_id, quality (0 or 1); other columns are ignored. The model is fitted on at
    most `most` labelled documents of each class, without those whose crc32 of the id modulo held_out[0] is
    held_out[1]. A null text counts as empty; an empty text gets the score of the bias alone; a null doc_id
    stays null; repeated rows are scored each; an empty table gives no rows. Without labels of both classes
    every score is the labels' mean (0.5 without any).
    """
    texts, known, share = sample(docs, labels, held_out, most)
    if len(set(known)) < 2:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(np.mean(known)) if known else 0.5).alias("score"))
    w, a, b, ratio = fit(texts, known, share, bits)
    square = ratio**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.array([margin_of(t.as_buffer().to_pybytes(), w, square, bits) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-(a * margin + b))), 9))], ["doc_id", "score"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float, held_out: tuple[int, int] | None = None, most: int = 1500, bits: int = BITS) -> DataFrame:
    """The documents, with all their columns, whose score is `threshold` or more; see score for the rest."""
    texts, known, share = sample(docs, labels, held_out, most)
    if len(set(known)) < 2:
        return docs
    w, a, b, ratio = fit(texts, known, share, bits)
    square = ratio**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [margin_of(t.as_buffer().to_pybytes(), w, square, bits) * a + b >= np.log(threshold / (1 - threshold)) for t in batch.column(batch.num_columns - 1)]
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return with_bytes(docs).mapInArrow(run, docs.schema)
