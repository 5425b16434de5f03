"""Algebra of runs (keys, start, n) and cells: painting runs over another, and what is tied together on a grid.

Rows follow runs, never the positions that they cover. Runs are cut at the edges of fixed blocks, so what meets in one
group is bounded by a block's width, not by how many runs a row holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.idioms import written


def block_of(at: Column, block: int) -> Column:
    return (at - F.pmod(at, F.lit(block))) / F.lit(block)


def painted(runs: DataFrame, keys: list[str], order: list[str], values: list[str], *, start: str = "start", n: str = "n", block: int = 1024) -> DataFrame:
    """Disjoint pieces (keys, start, n, values) of what is seen when runs are laid over each other, the last in order on top.

    Keys hold no nulls. Runs with n below 1 cover nothing. A piece ends where any run begins or ends, or at a block's
    edge, so a block gives at most `block` pieces however many runs lie in it.
    """
    at, size = F.col(start).cast("long"), F.col(n).cast("long")
    edge = lambda at: block_of(at, block).cast("long")
    cut = runs.where(F.col(n) > 0).withColumn("_b", F.explode(F.sequence(edge(at), edge(at + size - 1))))
    cut = cut.withColumns({"_from": F.greatest(at, F.col("_b") * block), "_to": F.least(at + size, (F.col("_b") + 1) * block)})
    cut = written(cut.select(*dict.fromkeys([*keys, *order, *values]), "_b", "_from", "_to"), "painted")
    ends = cut.select(*keys, "_b", F.explode(F.array("_from", "_to")).alias("_e")).groupBy(*keys, "_b").agg(F.array_sort(F.collect_set("_e")).alias("_ends"))
    piece = cut.join(written(ends, "painted"), [*keys, "_b"]).withColumn("_i", F.explode(F.sequence(F.array_position("_ends", F.col("_from")), F.array_position("_ends", F.col("_to")) - 1)))
    piece = piece.withColumns({"_at": F.element_at("_ends", F.col("_i").cast("int")), "_stop": F.element_at("_ends", (F.col("_i") + 1).cast("int"))})
    top = piece.groupBy(*keys, "_at", "_stop").agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*values).alias("_v"))).alias("_top"))
    return top.select(*keys, F.col("_at").alias(start), (F.col("_stop") - F.col("_at")).alias(n), *[F.col(f"_top._v.{c}").alias(c) for c in values])


def components(edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, int]:
    """edges (a, b) -> (id, component) for every id that has an edge to another, and the number of rounds.

    Each round every node points at the least of its neighbourhood in an order that is dealt anew, pointers jump once,
    and the edges are drawn between the nodes pointed at: of a path some three quarters of the nodes go in a round. The
    rounds' pointers are followed back at the end. Nodes and edges are staged tables, so a hub's rows can be split.
    """
    pairs = lambda df: written(df.where("a <> b").distinct(), "edges")
    edges, levels = pairs(edges.select("a", "b")), []
    while not edges.isEmpty():
        if len(levels) == most_rounds:
            raise RuntimeError("components did not settle")
        dealt = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(dealt("b")).alias("_near"))
        points = written(near.select(F.col("a").alias("id"), F.least("_near", dealt("a"))["to"].alias("to")), "pointers")
        points = written(points.join(points.select(F.col("id").alias("to"), F.col("to").alias("_next")), "to").select("id", F.col("_next").alias("to")), "pointers")
        levels.append(points)
        moved = edges
        for side in ("a", "b"):
            moved = moved.join(points.select(F.col("id").alias(side), F.col("to").alias(f"_{side}")), side)
        edges = pairs(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")), 0
    known = levels[-1]
    for points in reversed(levels[:-1]):
        further = known.select(F.col("id").alias("to"), F.col("to").alias("_root"))
        known = written(points.join(further, "to", "left").select("id", F.coalesce("_root", "to").alias("to")), "components")
    return known.withColumnRenamed("to", "component"), len(levels)


def marked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, seed) -> ids of those that edges (a, b) tie to a seed."""
    comps, _ = components(edges)
    placed = written(nodes.join(comps, "id", "left").select("id", "seed", F.coalesce("component", "id").alias("component")), "placed")
    return placed.join(placed.where("seed").select("component").distinct(), "component", "left_semi").select("id")


def tied_runs(runs: DataFrame, groups: list[str], seed: Column, block: int = 64) -> DataFrame:
    """Runs (groups, y, x, n) that steps between cells, eight ways, tie to one for which seed holds; disjoint within a row.

    Groups hold no nulls.
    """
    node = F.struct(*groups, "y", "x")
    rows = written(runs.select(*groups, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("n").cast("long").alias("n"), F.coalesce(seed, F.lit(False)).alias("seed")), "runs")
    edge = lambda at: block_of(at, block).cast("long")
    low = rows.select(*groups, "y", node.alias("b"), F.col("x").alias("_x"), (F.col("x") + F.col("n")).alias("_end"), F.explode(F.sequence(edge(F.col("x")), edge(F.col("x") + F.col("n") - 1))).alias("_b"))
    high = rows.select(*groups, (F.col("y") + 1).alias("y"), node.alias("a"), F.col("x").alias("x"), (F.col("x") + F.col("n")).alias("end"), F.explode(F.sequence(edge(F.col("x") - 1), edge(F.col("x") + F.col("n")))).alias("_b"))
    below = high.join(low, [*groups, "y", "_b"]).where("_x <= end and x <= _end").select("a", "b")
    # Runs of a row may touch without a gap between them.
    ends = rows.select(*groups, "y", (F.col("x") + F.col("n")).alias("x"), node.alias("a")).join(rows.select(*groups, "y", "x", node.alias("b")), [*groups, "y", "x"]).select("a", "b")
    ids = marked(rows.select(node.alias("id"), "seed"), below.union(ends))
    return ids.select("id.*").join(rows, [*groups, "y", "x"]).select(*groups, "y", "x", "n")


#: Cells a side of the blocks that are labelled in one task each.
BLOCK = 256


def block_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each cell of one block the number of the first cell that it is tied to, eight ways."""
    x, y, n = x - x.min() + 1, y - y.min() + 1, len(x)
    grid, label = np.full((int(y.max()) + 2, int(x.max()) + 2), n, np.int64), np.arange(n)
    while True:
        grid[y, x] = label
        rows = np.minimum(grid, np.minimum(np.roll(grid, 1, 0), np.roll(grid, -1, 0)))
        near = np.minimum(rows, np.minimum(np.roll(rows, 1, 1), np.roll(rows, -1, 1)))[y, x]
        near = np.minimum(near, near[near])
        if (near == label).all():
            return label
        label = near


def reach(cells: DataFrame, seeds: DataFrame, groups: list[str], block: int = BLOCK) -> DataFrame:
    """Cells (groups, x, y) that a path of neighbouring cells of their group, eight ways, ties to a seed. Groups hold no nulls.

    Blocks of cells are labelled in one task each, so a task holds block * block cells at most; labels that touch over
    an edge of blocks are tied as a graph, in rounds that grow with the logarithm of the longest path.
    """
    keys, node = [*groups, "x", "y"], ["_bx", "_by", "_label"]
    marks = cells.select(*keys).distinct().join(seeds.select(*keys).distinct().withColumn("_seed", F.lit(True)), keys, "left")
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    marks = marks.select(*groups, x.alias("x"), y.alias("y"), block_of(x, block).cast("long").alias("_bx"), block_of(y, block).cast("long").alias("_by"), F.coalesce("_seed", F.lit(False)).alias("_seed"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        return part.assign(_label=block_labels(part["x"].to_numpy(), part["y"].to_numpy()))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in marks.dtypes) + ", _label long"
    cells = written(marks.groupBy(*groups, "_bx", "_by").applyInPandas(work, schema), "reach")
    label = F.struct(*groups, *node)
    edge = cells.where(f"pmod(x, {block}) in (0, {block - 1}) or pmod(y, {block}) in (0, {block - 1})")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) > (0, 0)]))
    moved = edge.select(*groups, "x", "y", label.alias("a"), steps.alias("s")).withColumns({"x": F.col("x") + F.col("s.a"), "y": F.col("y") + F.col("s.b")})
    ties = moved.join(edge.select(*keys, label.alias("b")), keys).select("a", "b")
    nodes = cells.groupBy(label.alias("id")).agg(F.max("_seed").alias("seed"))
    found = marked(nodes, ties).select("id.*")
    return cells.join(found, [*groups, *node], "left_semi").select(*keys)
