"""Connected components over edges, by alternating large and small stars; no edge leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Edges, staged. Large: ties each larger neighbour to the smallest of a node's neighbourhood; small: each smaller one.

    The neighbourhood's minimum is an aggregate with partial sums. It is written before it joins back, so that both sides
    of the join are dealt anew and Spark can split a hub's edges.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")
    tied = both.join(least, "a")
    keep = F.col("b") > F.col("a") if large else F.lit(True)
    out = tied.where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    done = stage(out.where("a <> b").distinct(), name)
    unstage(least)
    return done


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (id, component) for every id that has an edge; component is the least id reachable."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(most_rounds):
        large = star(edges, True, name)
        unstage(edges)
        edges = star(large, False, name)
        unstage(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def merged(comps: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """comps (id, component) after more links (a, b): only the links between components go round."""
    ca, cb = (comps.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = components(between, name)
    new = roots.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    old = comps.join(new, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return stage(old.union(roots.join(comps.select("id"), "id", "left_anti").select("id", "component")), name)
