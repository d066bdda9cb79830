"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.stash import Stash


def _towards_min(edges: DataFrame, nodes: str, neighbours: str) -> DataFrame:
    """(node, neighbour, least of the node and its neighbours)."""
    least = edges.groupBy(nodes).agg(F.min(neighbours).alias("_m"))
    return edges.join(least, nodes).withColumn("_m", F.least("_m", nodes))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that undirected edges reach.

    Loops and rows with a null end are ignored, so only nodes with a real edge are returned.
    Each round joins the edges with a per-node minimum, a partial aggregate. A hub's edges meet in
    one partition of that join, which adaptive execution splits (the other side is one row a node);
    stars shrink to their least node at once, so this is so in the first round only. Each
    round is written to the shared folder; the rounds grow with the logarithm of the graph's
    diameter.
    """
    stash = Stash(edges.sparkSession)
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = stash.put(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(a.isNotNull() & b.isNotNull() & (a != b))
        .distinct()
    )
    seen = _mark(now)
    for _ in range(max_rounds if seen[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_min(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: the node's smaller neighbours and the node itself point at their least
        small = _towards_min(large, "u", "v").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("_m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("_m").alias("v")),
                )
            ).alias("e")
        )
        after = stash.put(small.select("e.u", "e.v").where("u != v").distinct())
        stash.drop(now)
        mark, now = _mark(after), after
        if mark == seen:
            break
        seen = mark
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = own.select(F.col("component").alias("node"), "component").distinct()
    return own.select(F.col("u").alias("node"), "component").unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Two edge sets with one mark are taken as equal: a count and two sums of hashes."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.hash("v", "u").cast("long")),
        ).first()
    )
