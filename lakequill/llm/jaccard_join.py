"""Jaccard similarity join on word shingles, exact, by size-banded tiles with bitmap signatures.

Each document is the set of its distinct shingles (64-bit hashes); documents with one set are one node. In one order of
all shingles (rare ones first) two sets that link share c at least of the first n - ceil(n * threshold) + c of each
(see shared_keys): the keys under which nodes can meet. Nodes of a key and of neighbouring size bands meet in a tile of
bounded size. A pair's overlap is bounded from above by what both share with one hub and by the bits in which two
parity signatures differ; what passes under c keys is settled by intersecting the sorted sets.

Nodes that links have joined need no further links among themselves. So a share of the keys first holds each node
against the hubs of its keys, and then only keys that still hold several components go into tiles, where only pairs
across components meet. Copies and large groups of near copies thus cost about as many pairs as documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.components import components
from lakequill.llm.text import bitmap, doc_bytes, give_back, hashed_words, in_bitmap, kept, mix64, pieces, shingle_hashes

#: Bits of the signatures of sets below LONG shingles, below LARGE and from there. Sets from LONG also have one of their
#: own width, of two to four bits a shingle.
NARROW, MIDDLE, WIDE, LONG, LARGE = 512, 1024, 2048, 256, 700
#: Shingles counted at once; those in less than one document of OFTEN there count as rare.
COUNTED, OFTEN = 1_500_000, 1024
#: Two sets must share one key, or one for each so many shingles of the smaller.
EACH = 50
#: Keys of a node that take part in a hub round: so many or up to twice as many, drawn by hash.
DRAWN = 16
#: Nodes of a tile's side, and pairs compared at once.
TILE, PAIRS = 4096, 1 << 20
#: Keys that a task counts at once, and the bits by which their names are dealt.
HELD, DEALT = 1_000_000, 12
#: Documents of a partition at least: fewer don't pay for a task and its files.
EVEN = 4000
NO_ID = -(1 << 63)


def sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of a batch."""
    words, at = hashed_words(part.column("text").to_pylist())
    every = shingle_hashes(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(every[lo : hi - k + 1] if hi - lo >= k else shingle_hashes(words[lo:hi], hi - lo) if hi > lo else every[:0]))
    return out


def names(found: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set."""
    sizes = np.array([len(s) for s in found], np.int64)
    sums = np.zeros(len(found), np.uint64)
    if sizes.any():
        ends = np.cumsum(sizes)
        sums[sizes > 0] = np.add.reduceat(mix64(np.concatenate(found)), (ends - sizes)[sizes > 0])
    return mix64(sums + sizes.astype(np.uint64)).astype(np.int64)


def shared_keys(n: str, num: int, den: int) -> str:
    """SQL for the keys that a set of n shingles shares with every set that it links with, if that isn't smaller."""
    return f"least(greatest(1, {n} div {EACH}), ceil({n} * {num} / {den}))"


def signature(s: np.ndarray, width: int) -> bytes:
    """Whether the shingles of each slot are odd in number. What two sets share cancels out, so that they differ in as
    many shingles at least as their signatures in bits."""
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool)).tobytes()


def measured(rows: DataFrame, k: int) -> DataFrame:
    """doc, name, n and node of every row; and, where node is null, shingles that many of a run's documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        none = pa.array([[]], pa.list_(pa.int64()))

        def often() -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= max(3, len(held) // OFTEN)
            lists = [pa.array([x[some].astype(np.int64).tolist()], pa.list_(pa.int64())) for x in (shingle, times)]
            return pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([None], pa.int64()), *lists], ["doc", "name", "n", "node", "often", "times"])

        for batch in batches:
            for part in pieces(batch, 2 << 20):
                found = sets(part, k)
                blank = pa.concat_arrays([none] * 1).take(pa.array(np.zeros(len(found), np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("name"), pa.array([len(s) for s in found], pa.int64()), pa.array(names(found)), blank, blank], ["doc", "name", "n", "node", "often", "times"])
                held += found
                if sum(map(len, held)) > COUNTED:
                    yield often()
                    held = []
        if held:
            yield often()

    return rows.mapInArrow(run, "doc long, name long, n long, node long, often array<long>, times array<long>")


class Order:
    """The rank of shingles: those that many documents have come last."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray):
        turn = np.argsort(shingles)
        self.shingles, self.level = shingles[turn], (1 + 8 * np.log2(times[turn] + 1)).astype(np.uint64) << np.uint64(54)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.shingles & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = s >> np.uint64(10)
        hit = np.flatnonzero(self.maybe[(s & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.shingles, s[hit]), len(self.shingles) - 1)
            same = self.shingles[at] == s[hit]
            out[hit[same]] |= self.level[at[same]]
        return out


def filter_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with 16 bits for each id, 64 KB at least and 128 MB at most."""
    return bitmap(ids, column, min(max(math.ceil(math.log2(16 * ids.count() + 1)), 19), 30))


def with_keys(rows: DataFrame, k: int, num: int, den: int, order: Order, wanted: np.ndarray) -> DataFrame:
    """node, n, sig, full (a signature as wide as the set asks for; null for small sets) and keys of the rows whose
    place the bitmap `wanted` may hold, once for each task."""
    shared = rows.sparkSession.sparkContext.broadcast((order, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch.filter(pa.array(in_bitmap(batch.column("place").to_numpy(), bits))), 2 << 20):
                found = [s for s in sets(part, k) if len(s)]
                new = {i: s for i, s in zip(names(found).tolist(), found, strict=True) if i not in seen}
                seen.update(new)
                if not (found := list(new.values())):
                    continue
                sizes = np.array([len(s) for s in found])
                ranks = np.split(rank(np.concatenate(found)), np.cumsum(sizes)[:-1])
                most = np.minimum(sizes, sizes - -(-sizes * num // den) + np.maximum(1, sizes // EACH)).tolist()
                keys = [s[np.argpartition(r, p - 1)[:p]] if p < len(s) else s for s, r, p in zip(found, ranks, most, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)), pa.array(np.concatenate(keys).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names(found)), pa.array(sizes), pa.array([signature(s, NARROW if len(s) < LONG else MIDDLE if len(s) < LARGE else WIDE) for s in found], pa.binary()), pa.array([signature(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) >= LONG else None for s in found], pa.binary()), lists], ["node", "n", "sig", "full", "keys"])

    return rows.mapInArrow(run, "node long, n long, sig binary, full binary, keys array<long>")


def key_names(batch: pa.RecordBatch, num: int, den: int) -> list[np.ndarray]:
    """Two names of each key of a batch: among sets of the node's band and the one below, and of its band and the one
    above. Where nodes have no size n, one name among all sets."""
    lists = batch.column("keys")
    keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    if "n" not in batch.schema.names:
        return [mix64(keys)]
    band = np.repeat(bands(batch.column("n").to_numpy(), num, den), np.diff(lists.offsets.to_numpy())).astype(np.uint64)
    return [mix64(keys ^ mix64(b + np.uint64(1))) for b in (band, band + np.uint64(1))]


def recurring(nodes: DataFrame, num: int, den: int) -> np.ndarray:
    """A bitmap by the first bits of a key's names, 64 KB at least and 128 MB at most, that holds all keys that
    several nodes of sizes that may link have (see key_names). Names go through the shuffle in 4 bytes each; two keys
    of one name count as one that recurs."""
    keys = 2 * nodes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    bits = min(max(math.ceil(math.log2(4 * keys + 1)), 19), 30)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            names = np.sort(np.concatenate(held))
            spots = np.flatnonzero(np.bincount(names >> np.uint64(64 - DEALT), minlength=1 << DEALT))
            at = np.searchsorted(names, (spots.astype(np.uint64)) << np.uint64(64 - DEALT)).tolist() + [len(names)]
            low = (names >> np.uint64(32 - DEALT)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(spots), pa.array([low[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["spot", "names"])

        for batch in batches:
            held += key_names(batch, num, den)
            if sum(map(len, held)) > HELD:
                yield sent()
                held = []
        if sum(map(len, held)):
            yield sent()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held = None, []

        def marked() -> pa.RecordBatch:
            names = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in held]))
            some = names[1:][names[1:] == names[:-1]] >> np.uint32(32 - (bits - DEALT))
            here = np.zeros(1 << (bits - DEALT), bool)
            here[some] = True
            return pa.RecordBatch.from_arrays([pa.array([spot]), pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())], ["spot", "bits"])

        for batch in batches:
            for s, x in zip(batch.column("spot").to_pylist(), batch.column("names").to_pylist(), strict=True):
                if s != spot and held:
                    yield marked()
                    held = []
                spot = s
                held.append(x)
        if held:
            yield marked()

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = len(out) >> DEALT
    found = nodes.select(*[c for c in nodes.columns if c in ("n", "keys")]).mapInArrow(dealt, "spot long, names binary").repartition("spot").sortWithinPartitions("spot").mapInArrow(twice, "spot long, bits binary").toArrow()
    for spot, part in zip(found["spot"].to_pylist(), found["bits"], strict=True):
        out[spot * size : (spot + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def shared_alone(nodes: DataFrame, num: int = 1, den: int = 1) -> DataFrame:
    """nodes with `total` (how many keys each has) and only those keys that other nodes of a size to link with may have."""
    shared = nodes.sparkSession.sparkContext.broadcast(recurring(nodes, num, den))
    rest = [c for c in nodes.columns if c != "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        back = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        for batch in batches:
            lists = batch.column("keys")
            keys, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            some = np.logical_or.reduce([in_bitmap((x >> back).astype(np.int64), bits) for x in key_names(batch, num, den)])
            ends = np.concatenate(([0], np.cumsum(some)))[at - at[0]]
            left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[some]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(np.diff(at).astype(np.int64)), left], [*rest, "total", "keys"])

    return nodes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in nodes.dtypes if c != "keys") + ", total long, keys array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int, parts: int = 1 << 20) -> DataFrame:
    """(a, b) of the pairs that may link by their full signatures (all, where one of the sets is small)."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for i, (x, y, n, m) in enumerate(zip(batch.column("fa"), batch.column("fb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)):
                if x.is_valid and y.is_valid:
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    least = min(len(x), len(y))  # slots are the last bits of a shingle, so the wider one folds
                    x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), 0) for v in (x, y))
                    good[i] = (n + m - int(np.bitwise_count(x ^ y).sum())) * (num + den) >= 2 * num * (n + m)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    pairs = kept(pairs.coalesce(parts))
    full = nodes.select("node", "n", "full")
    both = pairs.join(full.toDF("a", "na", "fa"), "a").join(full.toDF("b", "nb", "fb"), "b")
    return both.select("a", "b", "na", "nb", "fa", "fb").coalesce(parts).mapInArrow(bounded, "a long, b long")


def contents(rows: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """node and items (its sorted set) of the rows whose place the bitmap `wanted` may hold, once for each task."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch.filter(pa.array(in_bitmap(batch.column("place").to_numpy(), shared.value))), 2 << 20):
                found = [s for s in sets(part, k) if len(s)]
                new = {i: s for i, s in zip(names(found).tolist(), found, strict=True) if i not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["node", "items"])

    return rows.mapInArrow(run, "node long, items binary")


def overlaps(pairs: DataFrame, rows: DataFrame, first: DataFrame, k: int, num: int, den: int, parts: int = 1 << 20) -> DataFrame:
    """(a, b, o, links) of pairs: the size of the intersection and whether the sets link."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, links = [], []
            for a, b in zip(batch.column("ia"), batch.column("ib"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges the two runs
                common.append(int((both[1:] == both[:-1]).sum()))
                links.append(den * common[-1] >= num * (len(both) - common[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(links, pa.bool_())], ["a", "b", "o", "links"])

    pairs = kept(pairs.coalesce(parts))
    ends = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node").select("place").coalesce(parts))
    items = contents(rows, k, filter_bits(ends, "place")).coalesce(parts)
    both = pairs.join(items.toDF("a", "ia"), "a").coalesce(parts).join(items.toDF("b", "ib"), "b").coalesce(parts)
    return kept(both.select("a", "b", "ia", "ib").mapInArrow(exact, "a long, b long, o long, links boolean"))


def bands(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets that link have one band or neighbouring ones."""
    return np.floor(np.log(n) / math.log(den / num) + 1e-9).astype(np.int64) if num < den else n


def members(nodes: DataFrame, apart: DataFrame, num: int, den: int) -> DataFrame:
    """A node's row for each of its keys in `apart` (key, blocks) and some others, if there are as many as a link asks
    for; no join and no shuffle. A key of one block is a tile (role 0); one of several is dealt over tiles by band and
    block, where a node is at home (bit 1: the tile's first side, 2: its second) and a visitor (4) in the next band."""
    heavy = apart.where("blocks > 1").toArrow().sort_by("key")  # at most one for TILE rows of members
    shared = nodes.sparkSession.sparkContext.broadcast((filter_bits(apart, "key"), heavy["key"].to_numpy(), heavy["blocks"].to_numpy()))
    rest = [c for c in nodes.columns if c != "keys"]

    def spread(keys: np.ndarray, row: np.ndarray, node: np.ndarray, band: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        x = (mix64(node.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(keys)), blocks)
        each = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        x, less = x[at], each < x[at]
        sides = [(at, band[at], x, each, np.where(each == x, 3, 1)), (at[less], band[at[less]], each[less], x[less], np.full(less.sum(), 2)), (at, band[at] + 1, each, x, np.full(len(at), 4))]
        at, band, i, j, role = (np.concatenate(c) for c in zip(*sides))
        tile = keys[at].view(np.uint64)
        for c in (band, i, j):
            tile = mix64(tile + mix64(c.astype(np.uint64) + np.uint64(1)))
        return tile.view(np.int64), role, row[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot, many = shared.value
        for batch in batches:
            lists, n = batch.column("keys"), batch.column("n").to_numpy()
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            some = in_bitmap(keys, bits)
            need = np.minimum(np.maximum(1, n // EACH), -(-n * num // den))  # as shared_keys()
            some &= (np.bincount(row, some, batch.num_rows) >= need)[row]
            keys, row = keys[some], row[some]
            wide = np.isin(keys, hot)
            tile, role = keys[~wide], np.zeros(int((~wide).sum()), np.int64)
            if wide.any():
                dealt = spread(keys[wide], row[wide], batch.column("node").to_numpy()[row[wide]], bands(n, num, den)[row[wide]], many[np.searchsorted(hot, keys[wide])])
                tile, role, row = (np.concatenate(c) for c in zip((tile, role, row[~wide]), dealt))
            for at in range(0, len(tile), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(tile[part]), pa.array(role[part].astype(np.int32)), *[batch.column(c).take(pa.array(row[part])) for c in rest]], ["tile", "role", *rest])

    return nodes.mapInArrow(run, "tile long, role int, " + ", ".join(f"{c} {t}" for c, t in nodes.dtypes if c != "keys"))


def tiles(rows: DataFrame, num: int, den: int, best: bool, parts: int) -> DataFrame:
    """(a, b) of the pairs that may link, by their bounds in tiles and by the keys that they share. rows: as members()
    gives them, of node, n, sig, component, size (of the component), pivot and o (what the node shares with its pivot).
    best: only the partner of the greatest bound for each node of a tile, whatever they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for some in opened(batches):
            waiting.append(some)
            if sum(x.num_rows for x in waiting) > PAIRS // 4:
                yield summed(waiting)
                waiting = []
        if waiting:
            yield summed(waiting)
        give_back()

    def summed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Each pair once, with the number of its keys."""
        a, b, n = (np.concatenate([x.column(c).to_numpy() for x in some]) for c in ("a", "b", "n"))
        turn = np.lexsort((b, a))
        a, b, n = a[turn], b[turn], n[turn]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n[first]), pa.array(np.diff(np.append(first, len(a))))], ["a", "b", "n", "c"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = table.column("tile").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            yield from met(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from met(held)

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        tile, role, node, n, own, size, pivot, o = (table.column(c).to_numpy() for c in ("tile", "role", "node", "n", "component", "size", "pivot", "o"))
        # keys that are one tile: those that one component alone has go, the rest stand in their band and as visitors in the next
        begin = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(tile))))
        here = np.flatnonzero((np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin))[group])
        if not len(here):
            return
        last = np.lexsort((own, size, group))[np.append(begin[1:], len(tile)) - 1]
        main, band = own[last][group], np.where(role == 0, bands(n, num, den), 0)
        away = here[role[here] == 0]
        spot, at = np.concatenate((band[here], band[away] + 1)), np.concatenate((here, away))
        as_ = np.concatenate((np.where(role[here] == 0, 3, role[here]), np.full(len(away), 4)))
        turn = np.lexsort((spot, group[at]))
        at, spot, role = at[turn], spot[turn], as_[turn]
        tile, main, node, n, own, pivot, o = (x[at] for x in (group, main, node, n, own, pivot, o))
        sigs = table.column("sig").take(pa.array(at)).to_pylist()
        width = np.array([len(s) * 8 for s in sigs])
        # in as many bits as the narrower of two has: a signature folds, its parts added without carry
        packed = np.frombuffer(b"".join([s + bytes(WIDE // 8 - len(s)) for s in sigs]), np.uint64).reshape(len(sigs), -1)
        narrow, middle = (np.bitwise_xor.reduce(packed.reshape(len(sigs), WIDE // w, -1), 1) for w in (NARROW, MIDDLE))
        other = own != main
        # the second side of each tile with the nodes outside the main component first: those inside meet no others
        start = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (spot[1:] != spot[:-1]))))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(tile))))
        right = np.flatnonzero(role & 6)
        right = right[np.lexsort((~other[right], group[right]))]
        count = np.bincount(group[right], minlength=len(start))
        few = np.bincount(group[right], other[right], len(start)).astype(np.int64)
        begin = np.cumsum(count) - count
        left = np.flatnonzero(role & 1)
        many = np.where(other[left], count[group[left]], few[group[left]])
        turn = np.cumsum(many) // PAIRS
        for rows in np.split(np.arange(len(left)), np.flatnonzero(np.diff(turn)) + 1) if len(left) else ():
            for lo in range(0, int(many[rows].max()), 4 * PAIRS) if len(rows) == 1 else (0,):
                size = many[rows] if len(rows) > 1 else np.minimum(many[rows] - lo, 4 * PAIRS)
                l = np.repeat(left[rows], size)
                r = right[np.arange(len(l)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[group[left[rows]]] + lo, size)]
                # of two nodes of one block each pair counts once: by the one outside the main component, else in order
                good = (own[l] != own[r]) & ((role[r] != 3) | (other[l] & ~other[r]) | ((other[l] == other[r]) & (l < r)))
                l, r = l[good], r[good]
                small, large = np.minimum(n[l], n[r]), np.maximum(n[l], n[r])
                good = small * den >= large * num
                l, r = l[good], r[good]
                need = num * (n[l] + n[r])
                most = np.where(pivot[l] == pivot[r], np.minimum(o[l], o[r]) + np.minimum(n[l] - o[l], n[r] - o[r]), n[l])
                good = most * (num + den) >= need
                l, r, need = l[good], r[good], need[good]
                both = np.minimum(width[l], width[r])
                for bits, some in ((narrow, both == NARROW), (middle, both == MIDDLE), (packed, both == WIDE)):
                    a, b, least = l[some], r[some], need[some]
                    for at in range(0, len(a), 1 << 16):
                        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                        up = (n[i] + n[j] - np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)) // 2
                        open_ = up * (num + den) >= least[at : at + (1 << 16)]
                        if open_.any():
                            i, j, up = i[open_], j[open_], up[open_]
                            if best:
                                turn_ = np.lexsort((-up, i))
                                one = turn_[np.unique(i[turn_], return_index=True)[1]]
                                i, j = i[one], j[one]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(n[i], n[j]))], ["a", "b", "n"])

    pairs = rows.repartition("tile").coalesce(parts).sortWithinPartitions("tile").mapInArrow(run, "a long, b long, n long, c long")
    if best:
        return pairs.select("a", "b").distinct()
    return pairs.coalesce(parts).groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where(f"c >= {shared_keys('n', num, den)}").select("a", "b")


def classes(docs: DataFrame, k: int, num: int, den: int, hub_rounds: int = 1, tries_each: int = 3) -> DataFrame:
    """doc (NO_ID for null), name (a hash of the text), n and component (a node; null without shingles) of every row."""
    rows = doc_bytes(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("name"), "text").withColumn("place", F.xxhash64("doc", "name"))
    every = kept(measured(rows, k))
    count = every.where("node is not null").count()
    parts = max(1, -(-count // EVEN))

    def few(df: DataFrame) -> DataFrame:
        return kept(df.coalesce(parts))

    base = every.coalesce(parts).where("node is not null").select("doc", "name", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    first = few(base.where("n > 0").groupBy("node").agg(F.min(F.xxhash64("doc", "name")).alias("place")))
    often = every.coalesce(parts).where("node is null").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("times"))
    heavy = often.where(F.col("times") >= max(3, count // 2000)).toArrow()  # at most 2,000 times the mean size of a set
    order = Order(heavy["often"].to_numpy().astype(np.uint64), heavy["times"].to_numpy().astype(float))
    nodes = few(shared_alone(kept(with_keys(rows, k, num, den, order, filter_bits(first, "place"))).coalesce(parts), num, den))
    links = first.limit(0).selectExpr("node as a", "node as b")
    near, named = [], links.toDF("node", "component")

    for turn in range(hub_rounds):
        # every 2**i-th key; what a node with more keys draws, one with fewer keys draws too
        each = F.expr(f"shiftleft(1L, cast(log2(greatest(total div {DRAWN}, 1)) as int))")
        some = nodes.select("node", "n", (F.col("total") / each).alias("all"), F.filter("keys", lambda x: F.pmod(F.shiftright(x, 16 * turn), each) == 0).alias("some"))
        some = some.join(named, "node", "left") if turn else some.withColumn("component", F.col("node"))
        some = some.select("node", "n", F.coalesce("component", "node").alias("component"), "all", F.explode("some").alias("key"))
        apart = few(some.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
        found = few(some.join(apart, "key"))
        share = found.groupBy("node").agg((F.count("*") / F.first("all")).alias("share"))
        # the first hubs have the largest share of shared keys, as originals have among their edited copies; later ones any
        by = F.struct(F.col("share") if turn == 0 else F.lit(0.0), F.xxhash64("node", F.lit(turn)), "node", "n", "component")
        hubs = few(found.join(share, "node").coalesce(parts).groupBy("key").agg(F.max(by).alias("h")).selectExpr("key", "h.node as hub", "h.n as hub_n", "h.component as main"))
        tries = found.join(hubs, "key").where(f"component <> main and least(n, hub_n) * {den} >= greatest(n, hub_n) * {num}").coalesce(parts).groupBy("node", "hub").agg(F.count("*").alias("count"), F.first("all").alias("all")).where("count >= 2 or all < 4")
        best = tries.coalesce(parts).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "hub")), False), 1, tries_each).alias("h"))
        got = overlaps(best.select(F.col("node").alias("a"), F.explode("h.hub").alias("b")), rows, first, k, num, den, parts)
        near.append(got.select("a", "b", "o"))
        links = links.union(got.where("links").select("a", "b"))
        named = few(components(links))
    hub = near[0].select(F.col("b").alias("node")).distinct().join(nodes.select("node", "n"), "node").selectExpr("node", "node as pivot", "n as o")
    pivots = few(near[0].selectExpr("a as node", "b as pivot", "o").union(hub.coalesce(parts)).groupBy("node").agg(F.max(F.struct("o", "pivot")).alias("p")).selectExpr("node", "p.pivot", "p.o"))
    known = few(nodes.select("node", "n", "sig", "keys").join(pivots, "node", "left").selectExpr("node", "n", "sig", "coalesce(pivot, node) as pivot", "coalesce(o, n) as o", "keys"))

    for best in (True, False):  # each node's likeliest partners first; of what they leave apart, every pair
        sizes = few(named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component"))
        now = few(known.join(sizes, "node", "left").withColumns({"component": F.coalesce("component", "node"), "size": F.coalesce("size", F.lit(1))}))
        # keys of several components, and the blocks that a key's nodes are dealt over
        every_key = now.select("component", F.explode("keys").alias("key")).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"))
        # two nodes alone with a key have been each other's likeliest partner there, so their pair is settled
        apart = few(every_key.where("lo < hi" if best else "lo < hi and many > 2").selectExpr("key", f"(many + {TILE - 1}) div {TILE} as blocks"))
        got = overlaps(likely(tiles(members(now, apart, num, den), num, den, best, parts), nodes, num, den, parts), rows, first, k, num, den, parts)
        links = links.union(got.where("links").select("a", "b"))
        named = few(components(links))
    return base.join(named, "node", "left").select("doc", "name", "n", F.coalesce("component", "node").alias("component")).coalesce(parts)


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; two link when den * overlap >= num * union.

    docs: doc_id, text; other columns are ignored. A-Z count in lower case; with fewer than k words the whole
    text is one shingle; a null text or one without words has none and links with nothing. component_id is the
    least doc_id that links reach. A null doc_id takes part but names no component (null if a component has no
    other id); a repeated doc_id counts as one document for each row; an empty table gives no rows. Exact for
    any order of shingles; counts of frequent ones only make keys rare.
    """
    rows = kept(classes(docs, k, num, den))
    least = rows.where("n > 0").groupBy("component").agg(F.min(F.nullif("doc", F.lit(NO_ID))).alias("least"))
    doc = F.nullif("doc", F.lit(NO_ID))
    return rows.join(least, "component", "left").select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(doc).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, with all columns: the least doc_id (null last), of its rows the least hash of
    the text, of rows with one id and text any one. Texts without shingles all stay. See join() for the rest."""
    rows = kept(classes(docs, k, num, den))
    order = F.struct((F.col("doc") == NO_ID).alias("none"), "doc", "name")
    firsts = rows.where("n > 0").groupBy("component").agg(F.min(order).alias("f")).select("f.doc", "f.name")
    stay = kept(firsts.union(rows.where("n = 0").select("doc", "name")).distinct())
    gone = kept(rows.select("doc", "name").distinct().join(stay, ["doc", "name"], "left_anti").select(F.xxhash64("doc", "name").alias("place")))
    twins = kept(rows.where("n > 0").groupBy("doc", "name").agg(F.count("*").alias("many")).where("many > 1").join(stay, ["doc", "name"], "left_semi").select("doc", "name"))
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(gone.union(twins.select(F.xxhash64("doc", "name"))), "place"))

    def touched(places: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(places.to_numpy(), bits.value))

    # most rows stay for certain and cross no shuffle
    told = named.withColumn("maybe", F.pandas_udf(touched, "boolean")(F.xxhash64("doc", "name")))
    some = told.where("maybe").join(stay, ["doc", "name"], "left_semi").select("row", "doc", "name")
    if not twins.isEmpty():
        some = some.join(twins, ["doc", "name"], "left_anti").union(some.join(twins, ["doc", "name"], "left_semi").dropDuplicates(["doc", "name"]))
    left = told.where("not maybe").select("row").union(some.select("row"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
