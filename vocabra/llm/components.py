"""Connected components over an edge table, in rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Tie neighbours to the smallest one: those above a node (large), or a node and those below it (small)."""
    both = edges.select("u", "v").where("u <> v")
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        tied = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        out = tied.union(own)
    else:
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id that has an edge to a larger or smaller one.
    Self-edges and repeated edges do no harm. Each round is written to the checkpoint folder."""
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = cut(_stars(_stars(now, small=False), small=True))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(nodes.select("component", "component")).distinct()
