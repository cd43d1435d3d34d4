"""What the operators of this subpackage share: how they read documents and split words."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of `\x20\x09-\x0D`; bytes.split() splits at exactly these.
SPACES = b" \t\n\r\x0b\x0c"


def doc_bytes(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long and text as UTF-8 bytes (null text: empty); every other column is left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def with_bytes(docs: DataFrame) -> DataFrame:
    """docs with one column more, the last: the text as UTF-8 bytes (null text: empty), under a name that docs lacks."""
    small_batches(docs.sparkSession)
    name = "__bytes"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return docs.select("*", F.coalesce("text", F.lit("")).cast("binary").alias(name))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python 2,000 at a time (for the rest of the session), which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def fold(of: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (null id: null)."""
    return F.crc32(F.col(of).cast("string") if isinstance(of, str) else of.cast("string")) % parts


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, so that scratch arrays stay small."""
    at, size = 0, 0
    lengths = batch.column("text").to_pandas().str.len().to_numpy() if batch.num_rows else []
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= most:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and its executor's other workers need the room."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word windows over word hashes (order counts); words must number k at least."""
    n = len(words) - k + 1
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) << np.uint64(9))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        room = max(n, 1 << 16)
        for i, base in enumerate((_STEP, _BACK)):
            _POWERS[i] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(room - 1, base))))
    return _POWERS[0][:n], _POWERS[1][:n]


def window_sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:stop] for each pair, the same wherever the values stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def word_spans(texts: list[bytes], lower: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row, where words begin and end there, and the first word of each text (one more entry than texts)."""
    data = b" ".join([*texts, b""])
    data = data.lower() if lower else data
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return data, edge[::2], edge[1::2], np.searchsorted(edge[::2], at)


def span_hashes(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop]."""
    return window_sums(_BYTES[np.frombuffer(data, np.uint8)], starts, stops)


def hashed_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and where each text's begin (one more entry than texts)."""
    data, starts, stops, at = word_spans(texts, lower)
    return span_hashes(data, starts, stops), at


def distinct(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones (by hash) of all data[start:stop], and for each its place among them."""
    _, first, back = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    return [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], back


class Memo:
    """What `learn` makes of pieces of bytes, kept for recent ones: two generations of about `room` pieces."""

    def __init__(self, learn: Callable[[list[bytes]], list], room: int):
        self.learn, self.room, self.new, self.old = learn, room, {}, {}

    def __call__(self, found: list[bytes]) -> list:
        new, old = self.new, self.old
        out = [*map(new.get, found)]
        fresh = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := old.get(found[i])) is None:
                fresh.append(i)
            else:
                out[i] = new[found[i]] = x
        if fresh:
            some = [found[i] for i in fresh]
            got = self.learn(some)
            new.update(zip(some, got, strict=True))
            for i, x in zip(fresh, got, strict=True):
                out[i] = x
        if len(new) > self.room:
            self.new, self.old = {}, new
        return out


def bitmap(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit array of fixed size with the low bits of all ids set, made by partial aggregation: a filter with
    false hits and no misses, whatever the number of ids."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    slot = F.col(column).bitwiseAND((1 << bits) - 1) + 1
    for r in ids.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).toLocalIterator():
        part = np.frombuffer(r.m, np.uint8)
        start = (r.b - 1) * 4096
        out[start : start + len(part)] = part[: len(out) - start]
    return out


def in_bitmap(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = ids.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error elsewhere."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = context.getCheckpointDir()
    return named


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that the loss of an executor repeats none of the work before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
