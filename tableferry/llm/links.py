"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.session import ensure_checkpoints


def _least(pairs: DataFrame) -> DataFrame:
    """Each node of (u, v) pairs with the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_m", "u").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component.

    Alternately hangs the larger neighbours of each node, then the smaller
    ones, below the smallest neighbour, until nothing moves; the number of
    rounds grows with the logarithm of the longest chain.  Each round is
    aggregates and equi-joins and is written to the shared checkpoint folder.
    Self links and repeated links change nothing; no links give no rows.
    """
    ensure_checkpoints(links.sparkSession)
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        moved = large.join(low, F.col("u") == F.col("_u")).select("u", "v", "m")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v")))
        edges = small.where("u != v").distinct().checkpoint()
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
