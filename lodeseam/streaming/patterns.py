"""Pattern counts of a stream: all counts a condition or itemset search needs are sums, so they grow in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.selectors import Selector, canonical
from lodeseam.operators.targets import Target


def pattern_counts(stream: DataFrame, selectors: list[Selector], target: Target) -> DataFrame:
    """(items, n, p) of a streaming or static table; run it in update or complete mode.

    The state is one row per distinct pattern. p is null for a target without positives.
    """
    chosen = canonical(selectors)
    items = F.array_compact(F.array(*[F.when(s.column(stream.schema), F.lit(i)) for i, s in enumerate(chosen)]))
    rows = stream.select(items.alias("items"), *target.columns(stream.schema))
    positives = F.sum("_y") if target.kind == "binary" else F.lit(None).cast("long")
    return rows.groupBy("items").agg(F.count(F.lit(1)).alias("n"), positives.alias("p"))


def subgroup_counts(patterns: DataFrame, depth: int) -> DataFrame:
    """(items, n, p) of every subset of 1 .. depth selectors, from pattern counts."""
    level = patterns.select(F.array().cast("array<int>").alias("t"), F.col("items").alias("rest"), "n", "p")
    out = None
    for _ in range(depth):
        step = level.select("t", "rest", "n", "p", F.posexplode("rest").alias("at", "e"))
        level = step.select(F.concat("t", F.array("e")).alias("t"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n", "p")
        out = level if out is None else out.union(level)
    return out.groupBy(F.col("t").alias("items")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
