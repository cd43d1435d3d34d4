"""Exact top-k inner products by block-at-a-time pruning.

Vectors are packed into blocks, each with the greatest and least value of every term (component). A query's
bound for a block sums, over its terms, what the block can give at most. Within a tile (a chunk of queries
and a shard of blocks) each query takes the blocks in falling order of bounds, scores them through their
forward index and stops when the next bound falls below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 512


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """id and integer components floor(scale * x); vectors null or with null or non-finite components are left out."""
    e = F.col("embedding").cast("array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("id"), F.transform(e, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def packed(rows: DataFrame, size: int, group: Column) -> DataFrame:
    """Rows (g, dim, ids, vecs): runs of at most `size` vectors of one group and dimension, as binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for pdf in batches:
            for g, i, v in zip(pdf["g"], pdf["id"], pdf["v"], strict=True):
                mine = held.setdefault(key := (g, len(v)), [])
                mine.append((i, v))
                if len(mine) == size:
                    yield pack(g, held.pop(key))
        for (g, _), mine in held.items():
            yield pack(g, mine)

    def pack(g: int, rows: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[0])
        return pd.DataFrame({"g": [g], "dim": [len(rows[0][1])], "ids": [np.array([i for i, _ in rows], np.int64).tobytes()], "vecs": [np.concatenate([v for _, v in rows]).astype(np.float64).tobytes() if len(rows[0][1]) else b""]})

    return rows.withColumn("g", group).repartition("g").mapInPandas(run, "g long, dim int, ids binary, vecs binary")


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query in one shard, ties to the lesser id."""
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, 1, kind="stable")
    best_score, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    alive = np.arange(len(q))
    for turn in range(len(starts)):
        b = order[alive, turn]
        alive = alive[bound[alive, b] >= best_score[alive, -1]]
        b = order[alive, turn]
        if not len(alive):
            break
        for j in np.unique(b):
            rows, span = alive[b == j], slice(starts[j], starts[j] + block)
            s = q[rows] @ x[span].T
            s[query_ids[rows][:, None] == ids[span][None]] = -np.inf
            scores = np.concatenate([best_score[rows], s], 1)
            both = np.concatenate([best_id[rows], np.broadcast_to(ids[span], s.shape)], 1)
            top = np.lexsort((both, -scores), axis=1)[:, :k]
            best_score[rows], best_id[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(both, top, 1)
    row, col = np.nonzero(best_score > -np.inf)
    return query_ids[row], best_id[row, col], best_score[row, col]


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, chunk: int = 2048, shard: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors, ties to the lesser vec_id.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. is_query picks the queries. Components become floor(scale * x); scores are integer inner products (exact below 2**53). Vectors
    that are null, hold null or non-finite components or have no vec_id take no part; a query meets vectors of
    its own length only; a query without any gets no rows; of rows that share a vec_id each is a
    candidate (never of its own query) and the least vector is the query; an empty table gives no rows. Chunks of `chunk` queries meet shards of `shard`
    vectors in tiles, so a task holds one of each, and only k rows a query leave a tile.
    """
    rows = quantised(vectors, scale)
    asking = quantised(vectors.where(is_query), scale).groupBy("id").agg(F.min("v").alias("v"))
    shards, chunks = (max(1, -(-n // size)) for n, size in ((rows.count(), shard), (asking.count(), chunk)))
    docs = packed(rows, shard, F.pmod(F.xxhash64("id"), F.lit(shards)))
    asks = packed(asking, chunk, F.pmod(F.xxhash64("id"), F.lit(chunks))).selectExpr("dim", "ids as q_ids", "vecs as q_vecs", f"explode(sequence(0L, {shards - 1}L)) as g")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                q, i, s = tile(q_ids, np.frombuffer(r.q_vecs).reshape(-1, r.dim), ids, np.frombuffer(r.vecs).reshape(-1, r.dim), k)
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s.astype(np.int64)})

    found = asks.join(docs, ["g", "dim"]).mapInPandas(tiles, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
