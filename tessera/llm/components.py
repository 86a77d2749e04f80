"""Connected components of a link table by star contraction (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges has u > v. Each node's lowest neighbour is found by a map-side combined minimum, then met by an
    equality join that AQE splits where a node is hot."""
    sides = edges.select("u", "v")
    if large:
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = sides.join(low, "u")
    if large:  # every larger neighbour, and no other, goes to the lowest
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # all lower neighbours and the node itself go to the lowest
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long links to (node, root) of every node that has a link; root is the lowest node of its component.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest chain. Ends when a round changes nothing.
    """
    edges = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(edges, True), False))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(links.sparkSession, edges)
        edges = after
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
