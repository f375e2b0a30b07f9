"""Connected components of a graph of ids, as alternating star steps over DataFrames.

Each step is an aggregate with map-side combine and a join that Spark can split where a
node is hot; nothing is gathered by node and nothing comes to the driver but a count
and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours (all larger ones, or all smaller ones and the node itself) to the smallest neighbour."""
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    seen = back.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else back
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = seen.join(dealt_anew(least, "u"), "u")
    if large:
        return both.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return both.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node`` and ``root``, the smallest id of its component, for every node that has an edge (columns a < b, no nulls; ``rows`` of them at most)."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    edges = staged(edges.select("a", "b").distinct(), "edges", rows)
    before = state(edges)
    while before[0]:
        edges = staged(_star(_star(edges, True).distinct(), False).distinct(), "edges", before[0])
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
