"""Packing token ids into fixed windows, cut at document or sentence ends where that costs little.

Order-preserving dynamic programming: documents keep their order within a partition, and the cuts of a run
of documents are those with the least sum of padding and truncation penalties. With f(j) the least cost of
all windows before cut j, f(j) = penalty(j) + window - j + min over i in [j - window, j) of f(i) + i, and
the minimum comes from a monotone queue, so a run costs time in proportion to its possible cuts: the ends of all
documents and sentences.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import Memo, distinct, doc_bytes, give_back, pieces, word_spans

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordEncoder:
    """A word-level BPE with a memory of recent words, equal to encoding each text whole.

    The pre-tokenizer drops white space and no pattern of it spans any, so words can be encoded apart. Texts
    that hold a special token's marks or control separators, which the libraries split differently, go whole.
    """

    MARK = "\u00a4"
    ODD = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f")

    def __init__(self, path: str, room: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.memo = Tokenizer.from_file(path), Memo(self.learn, room)
        self.between = np.frombuffer(self.batch([self.MARK])[0], np.uint32)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        return [x for at in range(0, len(texts), 512) for x in self.words(texts[at : at + 512])]

    def words(self, some: list[str]) -> list[bytes]:
        """Ids of each word: all are encoded as one text, with a mark between them, unless a word holds it."""
        ids = np.frombuffer(self.batch([f" {self.MARK} ".join(some)])[0], np.uint32)
        k, hit = len(self.between), ids == self.between[-1]
        for i in range(1, k):
            hit[i:] &= ids[:-i] == self.between[k - 1 - i]
            hit[:i] = False
        ends = np.flatnonzero(hit)
        if len(ends) != len(some) - 1:
            return self.batch(some)
        raw, starts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
        return [raw[a:b] for a, b in zip(starts, [*(4 * (ends + 1 - k)).tolist(), len(raw)], strict=True)]

    def batch(self, texts: list[str]) -> list[bytes]:
        out = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in out]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. The vocabulary is in lower case, so A-Z are lowered first."""
        whole = {i: self.batch([t.decode("utf-8", "replace")])[0] for i, t in enumerate(texts) if any(x in t for x in self.ODD)}
        data, starts, stops, at = word_spans([b"" if i in whole else t for i, t in enumerate(texts)])
        if not len(starts):
            return [whole.get(i, b"") for i in range(len(texts))]
        found, back = distinct(data, starts, stops)
        row = pa.array(self.memo(found), pa.large_binary()).take(pa.array(back))
        ends = np.frombuffer(row.buffers()[1], np.int64)[row.offset : row.offset + len(row) + 1][at].tolist()
        raw = row.buffers()[2].to_pybytes()
        return [whole[i] if i in whole else raw[ends[i] : ends[i + 1]] for i in range(len(texts))]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """A worker's encoder, whose memory of words serves all tasks that the worker runs."""
    return WordEncoder(path)


def sentence_ends(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether it ends a sentence."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if re.fullmatch(r"[.!?]+(</w>)?", t)]] = True
    return ends


def places(n: int, doc_ends: np.ndarray, inner: np.ndarray, inner_cost: int, hard_cost: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of n tokens and their penalties: none at a document's end, `inner_cost` at a sentence's end, and
    `hard_cost` at every `gap`-th token where neither comes for longer."""
    cost = np.full(n + 1, -1, np.int32)
    cost[inner] = inner_cost
    cost[doc_ends] = 0
    at = np.flatnonzero(cost[1:n] >= 0) + 1
    before = np.concatenate(([0], at))
    steps = np.diff(np.append(before, n))
    for s in np.flatnonzero(steps > gap):
        cost[before[s] + gap : before[s] + steps[s] : gap] = hard_cost
    at = np.flatnonzero(cost[1:n] >= 0) + 1
    return at, cost[at]


def cuts(n: int, doc_ends: np.ndarray, inner: np.ndarray, window: int, inner_cost: int, hard_cost: int, gap: int) -> list[int]:
    """Ends of the windows over n tokens: those of least padding and penalties among all sequences of places() that end
    within a window of n. What remains after the last cut has windows of powers of two, which need no padding; each
    counts as 32 tokens.
    """
    at, penalty = places(n, doc_ends, inner, inner_cost, hard_cost, gap)
    place, price = [0, *at.tolist()], [0, *(penalty + window).tolist()]
    best, back = [0] * len(place), [0] * len(place)
    queue = deque([(0, 0, 0)])  # (cost up to a place plus the place, the place, its index), values ascending
    pop, push, left = queue.pop, queue.append, queue.popleft
    for j in range(1, len(place)):
        p = place[j]
        low = p - window
        head = queue[0]
        while head[1] < low:
            left()
            head = queue[0]
        value = head[0] + price[j]
        back[j], best[j] = head[2], value
        while queue and queue[-1][0] >= value:
            pop()
        push((value, p, j))
    first = next(i for i in range(len(place)) if place[i] >= n - window)
    last = min(range(first, len(place)), key=lambda i: best[i] - place[i] + 32 * (n - place[i]).bit_count())
    out, i = [], last
    while i:
        out.append(place[i])
        i = back[i]
    out.reverse()
    p = place[last]
    while p < n:  # a whole window, or the rest's powers of two from the largest down
        p += window if n - p >= window else 1 << ((n - p).bit_length() - 1)
        out.append(p)
    return out


def pack(docs: DataFrame, tokenizer_path: str, eos_id: int, window: int = 4096, run_tokens: int = 4_000_000, inner_cost: int = 8, hard_cost: int = 64, gap: int = 256) -> DataFrame:
    """Pieces of documents, packed into sequences of at most `window` tokens.

    docs: doc_id, text; other columns are ignored. Returns a row for each piece: doc_id, start (ids of its
    document before it), length, doc_tokens (with the end token), sequence_id, offset in the sequence and ids
    (binary, little-endian unsigned 32-bit). A null or empty text is its end token alone; a null doc_id is
    kept as null; repeated rows are packed each; an empty table gives no rows. A document longer than a window
    spans as many as it needs. Needs no shuffle: runs of `run_tokens` tokens within a partition are cut apart,
    which bounds a task's memory. `inner_cost` and `hard_cost` are the padding that a cut at a sentence's end
    or inside one is worth; cuts inside one are possible at every `gap`-th token without another place.
    """
    ends = sentence_ends(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker's tasks of earlier stages have freed, before the tokenizer is read
        encode = encoder(tokenizer_path)
        eos, sequence = array("I", [eos_id]).tobytes(), TaskContext.get().partitionId() << 32
        ids, encoded, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            all_ids = np.frombuffer(b"".join(encoded), np.uint32)
            lengths = np.array([len(x) // 4 for x in encoded], np.int64)
            doc_ends = np.cumsum(lengths)
            inner = np.flatnonzero(ends[np.minimum(all_ids, len(ends) - 1)]) + 1
            at = np.array(cuts(len(all_ids), doc_ends, inner, window, inner_cost, hard_cost, gap), np.int64)
            stop = np.union1d(at, doc_ends)
            start = np.concatenate(([0], stop[:-1]))
            doc, seq = np.searchsorted(doc_ends, start, "right"), np.searchsorted(at, start, "right")
            raw = pa.py_buffer(all_ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(start - (doc_ends - lengths)[doc]), pa.array(stop - start), pa.array(lengths[doc]), pa.array(seq + sequence), pa.array(start - np.concatenate(([0], at))[seq]), pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(np.concatenate((start, stop[-1:])).astype(np.int32) * 4), raw])],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += len(at)
            ids.clear(), encoded.clear()
            return out

        for batch in batches:
            for part in pieces(batch):
                ids += part.column("doc_id").to_pylist()
                got = [x + eos for x in encode(part.column("text").to_pylist())]
                encoded += got
                size += sum(map(len, got)) // 4
                if size >= run_tokens:
                    yield flush()
                    size = 0
        if encoded:
            yield flush()

    return doc_bytes(docs).mapInArrow(run, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
