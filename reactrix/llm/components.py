"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, spread_join


def star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step: each node's neighbours move to the least of the node and its (smaller) neighbours.

    The minimum is a map-side combined aggregate; it goes back to the neighbours by a join that leaves a hub's edges where they are.
    """
    if large:
        near = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    met = spread_join(near, least, "u", "n", n_edges * (2 if large else 1))
    moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u with an edge that isn't the least of its component; root is the least node.

    Stops when a large-star and a small-star step together change nothing, which holds only for stars around the roots.
    """
    def state(e):
        return e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        for large in (True, False):
            last, edges = edges, materialize(star(edges, large, edges.count()), "edges")
            drop_table(last)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("root"))
