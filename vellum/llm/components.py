"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, join_facts

#: Edges in one partition: the rounds are small jobs, and are cut to the size of their data.
EDGES = 200_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: two integer columns. Returns node, component: the smallest node that can be reached,
    for every node that has an edge to another.

    A large-star step links each node's larger neighbours to its smallest one, a small-star step
    does so with the smaller ones; in the end each component is a star. Each round is written
    out, and the rounds end when one changes nothing. An empty table gives no rows.
    """
    a, b = edges.columns[:2]

    parts = max(1, -(-edges.count() // EDGES))

    def cut(df: DataFrame) -> DataFrame:
        return df.coalesce(parts)

    def meet(some: DataFrame, least: DataFrame) -> DataFrame:
        """some (u, v) with m of least (u, m, n). One node may have a third of all edges: it is
        broadcast, unless all edges are one partition anyway."""
        return some.join(least.drop("n"), "u") if parts == 1 else join_facts(some, least, "u", parts * EDGES).drop("n")

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = scratch.put(cut(df.distinct()).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "edges")
        return out, tuple(sorted(seen.get.items()))

    kept, mark = put(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = cut(meet(both.where("v > u"), least)).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = cut(meet(large, least)).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_mark = put(small.unionByName(least.select("u", F.col("m").alias("v"))))
        scratch.drop(kept)
        kept = new
        if new_mark == mark:
            break
        mark = new_mark
    roots = cut(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return scratch.put(kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
