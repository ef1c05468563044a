"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.plans.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its least node.

    Alternates two steps on the edge table until it is stable.  *Large star*
    links every neighbour of a node that is larger than it to the least node
    of its neighbourhood, *small star* does so with the smaller ones.  Both
    are one aggregation (with partial minima before the shuffle) and one join
    on the node, so no group of edges is ever gathered in one place.  The minima
    are written before the join, which then has plain tables on both sides: so
    adaptive execution can split a node with very many edges; they are merged, so
    none is broadcast by way of the driver.  Each round is
    written to the scratch folder, so a lost executor costs no recomputation.

    Null ends and self-loops are dropped; repeated edges do no harm; an empty
    table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u != v")
    now = materialize(pairs.distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = _signature(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        new = _signature(now)
        if new == sign:
            break
        sign = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
