"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import kept

#: Links of a partition, where there are few: a small table needs no shuffle in each step of a round.
FEW = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (a, b) links reaches. Null ends are left out.

    Each round hangs a node's greater neighbours, then its lesser ones, on the least neighbour (two grouped
    minima and joins), and is checkpointed; rounds grow with the logarithm of the longest chain. A table of at most FEW
    links is one partition; any other is dealt over all of them.
    """
    links = links.coalesce(1) if links.count() <= FEW else links
    edges = kept(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while size[0]:
        if size[0] <= FEW:
            edges = edges.coalesce(1)
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = kept(small.distinct())
        last, size = size, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == size:
            break
    return edges.selectExpr("u as node", "v as component").union(edges.selectExpr("v as node", "v as component").distinct())
