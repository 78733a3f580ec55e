"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.lineage import cut, packed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima are pre-aggregated and joined back, so a hub's neighbours never meet in one task's memory."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it is connected to.

    ``edges`` may hold loops, repeats and either direction; rows with a null end are ignored. Each round is checkpointed; the
    rounds grow with the logarithm of the longest chain.
    """
    down = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current = packed(down.filter("a <> b").distinct())
    parts, seen = max(2, -(-current.count() // 100_000)), None  # edges never grow in number
    for _ in range(max_rounds):
        current = cut(_star(_star(current, True).coalesce(parts), False).coalesce(parts))
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components not settled in {max_rounds} rounds")
