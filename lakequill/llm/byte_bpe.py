"""Byte-level BPE by recursive queries in DuckDB, in each partition.

Rows of (piece, position, token) join the merge table on adjacent tokens; each round contracts every piece's
leftmost pair of least rank, until no piece has a pair to merge. Decoding joins ids with the vocabulary and
aggregates the bytes in order of position. A partition's distinct pieces go through these queries once; the
texts are then put together from their pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import Memo, distinct, doc_bytes, pieces

#: Rounds until fixpoint: s holds the rows of pieces that changed in the last round, each with its next token and
#: that token's position. A piece's last rows are its ids.
ENCODE = """
WITH RECURSIVE s AS (
    SELECT w, p, t, lead(t) OVER win AS next, lead(p) OVER win AS next_p, 0 AS round FROM start WINDOW win AS (PARTITION BY w ORDER BY p)
  UNION ALL
    SELECT w, p, t, lead(t) OVER win, lead(p) OVER win, round + 1
    FROM (
        SELECT s.w, s.p, CASE WHEN s.p = best.k % 1048576 THEN (best.k // 1048576)::INTEGER ELSE s.t END AS t, s.round
        FROM s JOIN (
            SELECT w, min(m * 1048576 + p) AS k, arg_min(next_p, m * 1048576 + p) AS gone
            FROM s JOIN merges ON pair = t::BIGINT * 4294967296 + next WHERE next IS NOT NULL GROUP BY w
        ) best ON s.w = best.w
        WHERE s.p <> best.gone
    ) WINDOW win AS (PARTITION BY w ORDER BY p)
)
SELECT s.w, s.p, s.t FROM s JOIN (SELECT w, max(round) AS round FROM s GROUP BY w) last ON s.w = last.w AND s.round = last.round
"""
#: Of each piece: its ids in order, a comma after each, and the bytes that the ids stand for, in the same order.
DECODE = "SELECT string_agg(t, ',' ORDER BY p) || ',' AS ids, unhex(string_agg(bytes, '' ORDER BY p)) AS raw FROM encoded JOIN vocab USING (t) GROUP BY w ORDER BY w"
#: Rounds grow with a piece's length and the rows with its square; longer pieces are merged by a heap over linked tokens.
LONGEST = 2048
#: Sum of squared lengths of the pieces of one query, which bounds its rows.
QUERY_ROWS = 8_000_000
ODD_SPACE = re.compile(r"[^\S \n]")
#: White space of ASCII but for space and line feed, with the separators that some libraries count.
ODD_BYTE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one very long piece: pairs come off a heap by rank, then by place."""
    import heapq

    n = len(piece)
    stop, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if not alive[i] or stop[i] != mid or mid >= n or not alive[mid] or stop[mid] != end:
            continue
        stop[i], after[i], alive[mid] = end, after[mid], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : stop[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end, stop[after[i]]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
            heapq.heappush(heap, (r, j, i, end))
    return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    """Ids of texts as tiktoken gives them, and their bytes again, with a memory of recent units of text.

    A unit is a run without spaces and line feeds, with the space or line feed before it. The pattern never
    lets a piece run on from a unit into the next, so units are encoded apart; texts with other white space,
    or with runs of it, are one unit each.
    """

    def __init__(self, path: str, pattern: str, room: int = 200_000):
        import duckdb
        import regex

        self.ranks, self.find, self.memo = read_ranks(path), regex.compile(pattern).findall, Memo(self.learn, room)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(a << 32 | z, r) for b, r in self.ranks.items() for i in range(1, len(b)) if (a := self.ranks.get(b[:i])) is not None and (z := self.ranks.get(b[i:])) is not None]
        self.con.register("given", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "m": pa.array([m for _, m in pairs], pa.int64())}))
        self.con.execute("CREATE TABLE merges AS FROM given")
        self.con.register("given", pa.table({"t": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array([b.hex() for b in self.ranks], pa.string())}))
        self.con.execute("CREATE TABLE vocab AS FROM given")
        self.one = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def query(self, found: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Of each piece: its ids in decimal, a comma after each, and the bytes that these decode to."""
        lengths = np.array([len(x) for x in found], np.int64)
        w = np.repeat(np.arange(len(found)), lengths)
        p = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.con.register("start", pa.table({"w": w.astype(np.int32), "p": p.astype(np.int32), "t": self.one[np.frombuffer(b"".join(found), np.uint8)]}))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE encoded AS {ENCODE}")
        return self.decode()

    def decode(self) -> list[tuple[bytes, bytes]]:
        """For each w of the rows (w, p, t) in `encoded`."""
        got = self.con.sql(DECODE).to_arrow_table()
        return [*zip(got["ids"].cast(pa.binary()).to_pylist(), got["raw"].to_pylist(), strict=True)]

    def learn(self, some: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids in decimal with a comma after each, decoded bytes) of these units."""
        split = [self.split(u) for u in some]
        new, old, known = self.memo.new, self.memo.old, {}
        for x in {x for xs in split for x in xs}:
            if (got := new.get(x) or old.get(x)) is not None:
                known[x] = got
            elif len(x) > LONGEST:
                ids = merge_long(x, self.ranks)
                vocab = {r: b for b, r in self.ranks.items()}
                known[x] = "".join(f"{i}," for i in ids).encode(), b"".join(vocab[i] for i in ids)
            else:
                known[x] = None
        missing = sorted((x for x, got in known.items() if got is None), key=len)
        turn = np.cumsum([len(x) ** 2 for x in missing]) // QUERY_ROWS
        for at in np.split(np.arange(len(missing)), np.flatnonzero(np.diff(turn)) + 1) if missing else ():
            part = missing[at[0] : at[-1] + 1]
            known.update(zip(part, self.query(part), strict=True))
        return [known[xs[0]] if len(xs) == 1 else (b"".join([known[x][0] for x in xs]), b"".join([known[x][1] for x in xs])) for xs in split]

    def split(self, unit: bytes) -> list[bytes]:
        """The pattern's matches; a space with letters, and a comma or full stop after them, needs no search."""
        text = unit.decode("utf-8", "replace")
        if text[0] == " ":
            if (word := text[1:]).isalpha():
                return [unit]
            if word[-1:] in {",", "."} and word[:-1].isalpha():
                return [unit[:-1], unit[-1:]]
        return [x.encode() for x in self.find(text)]

    def __call__(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Of each text: ids in decimal joined by commas, and the bytes they decode to."""
        data, starts, at = units(texts)
        if not data:
            return [(b"", b"")] * len(texts)
        found, back = distinct(data, starts, np.append(starts[1:], len(data)))
        got = self.memo(found)
        out = []
        for column in (0, 1):  # the units' values in a row: a text's are next to each other
            row = pa.array([x[column] for x in got], pa.large_binary()).take(pa.array(back))
            ends = np.frombuffer(row.buffers()[1], np.int64)[row.offset : row.offset + len(row) + 1][at]
            raw = row.buffers()[2].to_pybytes()
            out.append([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        return [(ids[:-1], raw) for ids, raw in zip(*out, strict=True)]


def units(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in a row, where their units begin there, and each text's first unit (one more entry than texts)."""
    data = b"".join(texts)
    b = np.frombuffer(data, np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    space = (b == 32) | (b == 10)
    last = np.zeros(len(b) + 1, bool)
    last[edge] = True
    odd = ODD_BYTE[b] | (space & (np.append(space[1:], True)[: len(b)] | last[1:]))
    whole = np.zeros(len(texts) + 1, bool)
    whole[np.searchsorted(edge, np.flatnonzero(odd), "right") - 1] = True
    for i, t in enumerate(texts):
        if not t.isascii() and ODD_SPACE.search(t.decode("utf-8", "replace")):
            whole[i] = True
    begin = space & ~np.repeat(whole[:-1], np.diff(edge))
    begin[edge[:-1][np.diff(edge) > 0]] = True
    starts = np.flatnonzero(begin)
    return data, starts, np.searchsorted(starts, edge)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> ByteBpe:
    """A worker's encoder, whose memory of units serves all tasks that the worker runs."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas, binary) and decoded (binary) of every document.

    docs: doc_id, text; other columns are ignored. A null or empty text has no ids and decodes to nothing; a
    null doc_id stays null; repeated rows give a row each; an empty table gives none. A text is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path, pattern)
        for batch in batches:
            for part in pieces(batch, 8 << 20):
                got = bpe(part.column("text").to_pylist())
                counts = [x.count(b",") + (len(x) > 0) for x, _ in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """Hashes in place of ids and decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
