"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Rounds after which the loop gives up; the number needed grows with the logarithm of the longest chain.
MOST_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v. Each node's lowest neighbour is an aggregate joined back to its neighbours,
    so the neighbours of a node are never gathered in one place."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    told = around.join(lowest, "u")
    out = told.where("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the lowest id reached) of every id in links (a, b).

    Loops, repeated links and either order of the two ids are allowed; links with a null are left out; no links give
    an empty table. Each round is written to the shared folder, so a lost executor costs at most one round.
    """
    edges = cut(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        edges = cut(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
