"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import scratch_table


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, or u itself, as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that has an edge and is not the root.

    ``edges`` has comparable columns u and v. Every round links each node's larger neighbours to its least one, then its
    smaller ones; the number of rounds grows with the logarithm of the longest path. Rounds are written to the shared
    folder, so a lost executor costs at most one of them. A node's neighbours are never collected.
    """
    turned = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch_table(turned.distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        joined = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = scratch_table(joined.select("e.*").where("u != v").distinct(), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
