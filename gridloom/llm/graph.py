"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``(node, component)``.

    Alternating large-star and small-star rounds: each node hooks its larger
    neighbours, then its smaller ones, to the smallest node it knows. A round
    is one grouped minimum (combined before the shuffle) and one join per
    star, so a hub's neighbours are never gathered in a list, and the edge
    count never grows. Rounds are logarithmic in the longest path. Every round
    is written to the shared folder, so a lost executor costs one round.

    Self loops and repeated edges are fine; rows with a null end are ignored;
    no edges give no rows. Node ids may be of any orderable type.
    """
    x, y = F.col(a), F.col(b)
    kept = edges.where(x.isNotNull() & y.isNotNull())
    current = staged(kept.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    loops = kept.where(x == y).select(x.alias("node"))
    for _ in range(max_rounds):
        # Large star: v > u, and u's smallest neighbour or itself -> m.
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Plain tables, so that the joins can split a hub.
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = staged(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        # Small star: u's smaller neighbours and u -> their smallest.
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, current = current, staged(small.where("u != v").distinct(), "edges")
        release(old, low, large, least)
        # Done once all are stars: a node hangs on one other, or others hang on it, but not both.
        ends = current.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(current.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").limit(1).count():
            break
    else:
        raise RuntimeError("connected components did not settle")
    pairs = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = current.select(F.col("v").alias("node")).unionByName(loops).distinct()
    alone = alone.join(pairs, "node", "left_anti").select("node", F.col("node").alias("component"))
    return pairs.unionByName(alone)
