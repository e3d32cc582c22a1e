"""Connected components of an edge table, by alternating stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour: the larger ones, or all smaller ones and the node."""
    near = edges.union(edges.select("low", "high")) if large else edges
    near = near.toDF("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        out = joined.select(F.col("v").alias("high"), F.col("m").alias("low")).union(least.select("u", "m"))
    return out.where("high <> low").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that have an edge; a component is named by its smallest node.

    An edge with a null end or with equal ends counts for nothing.
    """
    e = cut(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    last = None
    while True:
        e = cut(_stars(_stars(e, True), False))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.bit_xor(F.xxhash64("low", "high"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        e.select("low", "low").distinct())
