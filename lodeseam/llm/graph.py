"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.base import checkpointed


def _star(pairs: DataFrame, kept: str) -> DataFrame:
    """Every node's `kept` neighbours, and itself, tied to the least of its neighbourhood; pairs are (u, v)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u").where(kept).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))) if kept == "true" else tied


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (u, v), root the least node it can reach.

    Rounds grow with the logarithm of the longest path, and end when the table stays as it is. Each ends in the
    shared checkpoint folder; only a count and a checksum come to the driver. Links that repeat, turn round or tie
    a node to itself change nothing; a node with no other link has no row, so an empty table gives none. Nulls are
    not allowed in u and v, and other columns are not read.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _star(down, "true").where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == now:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
