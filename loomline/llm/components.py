"""Connected components by alternating stars, without ever holding a component in one place.

Each round links every node's larger neighbours to its smallest one (large star),
then its smaller ones (small star), until the edges are stars around each
component's smallest node. Rounds grow with the logarithm of the size. Smallest
neighbours are pre-aggregated; a node with very many neighbours is a skewed join
key, which adaptive execution splits. Each round's edges are written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Workspace


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(node, component): every node of the edges (u, v) with the smallest node that it reaches. Edges with a null or equal ends are none."""
    now = space.table(f"{name}-0", _directed(edges))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    before, k = state(now), 0
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = space.table(f"{name}-large-{k}", _directed(large))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = space.table(f"{name}-{k + 1}", _directed(small))
        space.drop(f"{name}-{k}", f"{name}-large-{k}")
        k += 1
        now, was, before = after, before, state(after)
        if was == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
