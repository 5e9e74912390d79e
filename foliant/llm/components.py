"""Connected components of an edge table, by alternating large and small stars; nothing is collected.

Edge cases: an edge from a node to itself or with a null end links nothing and is left out; repeated edges, and an edge
both ways round, are one; no edges give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges up to which a round runs in one task, without exchanges: some megabytes.  Beyond, rounds are shuffled.
ONE_TASK = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that each node of an edge reaches.

    Each round replaces edges by edges to the least neighbour, so the number of rounds grows with the logarithm of the
    longest path.  Neighbours are aggregated to their minimum before they meet, so a node may have any number of them.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    state = _state(now)
    small = state[0] <= ONE_TASK
    one = lambda df: df.coalesce(1) if small else df
    while True:
        now = one(now)
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))
        # larger neighbours, and the node itself, go to the least neighbour
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = one(large.union(least.select("a", F.col("m").alias("b")))).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # smaller neighbours, and the node itself, go to the least of them
        down = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(one(down.union(low.select("a", F.col("m").alias("b")))).filter("a <> b").distinct())
        found = _state(now)
        if found == state:
            break
        state = found
    now = one(now)
    return one(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
