"""Connected components of links between nodes, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Components of any shape are done in about log2(longest chain) rounds; this is a guard against a loop without end.
MAX_ROUNDS = 200


def components(links: DataFrame, where: str) -> DataFrame:
    """(node, root) for each node of links (a, b), root the smallest node reachable. Nodes are longs.

    Rounds of large-star and small-star: every node's larger neighbours, then its smaller ones, are hung
    on its smallest neighbour, until nothing changes. Each round is written to ``where``, so no plan grows.
    """
    edges = common.saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{where}/links")
    before = None
    for k in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        edges = common.saved(small.filter("u <> v").distinct(), f"{where}/round{k}")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
