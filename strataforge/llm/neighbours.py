"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample and index every row. A query walks all trees through one priority queue of
margins until the leaves it has opened hold enough rows; the rows of those leaves are then scored exactly. Leaves, not
pairs, travel: each group of a leaf's rows meets each block of the leaf's queries once and returns the best k for each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


@dataclass
class Tree:
    """Inner nodes: a direction, an offset and two children; a child below 0 is the leaf -child - 1."""

    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offsets) else np.full(len(x), -1)
        while len(todo := np.flatnonzero(at >= 0)):
            node = at[todo]
            side = np.einsum("ij,ij->i", x[todo], self.directions[node]) > self.offsets[node]
            at[todo] = self.children[node, side.astype(int)]
        return -at - 1


def grow(x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """Splits at the plane midway between the means of two random picks' sides; a set that no plane divides is a leaf."""
    directions, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, back = todo.pop()
        plane = split(x[rows], rng) if len(rows) > leaf_size else None
        if plane is None:
            leaves += 1
            at = -leaves
        else:
            at = len(offsets)
            directions.append(plane[0])
            offsets.append(plane[1])
            children.append([0, 0])
            side = x[rows] @ plane[0] > plane[1]
            todo += [(rows[~side], (at, 0)), (rows[side], (at, 1))]
        if back:
            children[back[0]][back[1]] = at
    return Tree(np.array(directions).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    for _ in range(8):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        direction = a - b
        if norm := np.linalg.norm(direction):
            direction = direction / norm
            along = x @ direction
            offset = float(np.median(along))
            share = np.mean(along > offset)
            if 0.05 < share < 0.95:
                return direction, offset
    return None


def probe(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until their rows are enough."""
    margins = [t.directions @ q - t.offsets for t in trees]
    queue = [(-np.inf, i, 0 if len(t.offsets) else -1) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    out, rows = [], 0
    while queue and rows < enough:
        far, i, at = heapq.heappop(queue)
        if at < 0:
            if n := counts[i][-at - 1]:
                out.append((i, -at - 1))
                rows += n
            continue
        m = margins[i][at]
        for side, child in enumerate(trees[i].children[at]):
            heapq.heappush(queue, (max(far, -m if side else m), i, int(child)))
    return out


def needed_share(trees: list[Tree], x: np.ndarray, ids: np.ndarray, k: int, recall: float, tries: int, rng: np.random.Generator) -> float:
    """Rows to visit, as a multiple of all rows, for the recall of ids on the sample itself; the number of trees at most.

    Vectors without any structure need a large share: no tree can say where their neighbours are.
    """
    one_each = np.unique(ids, return_index=True)[1]
    picks = rng.choice(one_each, min(tries, len(one_each)), replace=False)
    leaves = [t.leaf_of(x) for t in trees]
    counts = [np.bincount(at, minlength=t.leaves) for at, t in zip(leaves, trees, strict=True)]
    ranks = []  # for each true neighbour the share at which some leaf of its own is opened
    for p in picks:
        q = x[p].copy()
        q[-1] = 0
        scores = x @ q
        order = np.argsort(-scores, kind="stable")
        order = order[ids[order] != ids[p]]
        true = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]  # each id by its nearest row
        opened, rows = {}, 0
        for i, leaf in probe(trees, counts, q, len(x) * len(trees)):
            opened[i, leaf] = rows
            rows += counts[i][leaf]
        ranks += [min(opened[i, at[t]] for i, at in enumerate(leaves)) + 1 for t in true]
    return float(np.quantile(ranks, recall)) / len(x) if ranks else float(len(trees))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that equal vectors score equally wherever they stand."""
    products = np.ascontiguousarray((x * q).T)
    if products.shape[1] == 1:  # a single column would be summed in another order
        products = np.repeat(products, 2, axis=1)
    return np.add.reduce(products, axis=0)[: len(x)]


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, trees: int = 4, leaf_size: int = 256, sample: int = 20_000, recall: float = 0.95, tries: int = 100, group_rows: int = 4096, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (an id divisible by every), the query's own id excluded.

    Vectors that are null, zero, hold null or non-finite components, lack an id, or are of another length than most take
    no part. Rows that repeat an id and its vector are one row; an id with several vectors counts once, with its best
    score, and asks with all of them. Ties go to the smaller id. An empty table gives an empty one. sample bounds the
    rows that the trees are fitted on and that say how many rows a query must visit for the recall; every row is indexed
    and can be found. A query that has found fewer ids than there are to find visits every row.
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("_v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    out_schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size(v) == lengths["n"]).distinct()
    rows = rows.withColumns({"_sq": F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), "_n": F.monotonically_increasing_id()})
    rows = stage(rows, "ann-rows")
    top = float(rows.agg(F.max("_sq")).first()[0])
    picked = rows.orderBy(F.xxhash64("vec_id", "_v", F.lit(seed)), "vec_id").limit(sample).select("vec_id", "_v", "_sq").toPandas()

    def lifted(part: pd.DataFrame) -> np.ndarray:
        """One more component makes all lengths equal, so that a large inner product is a small distance."""
        return np.hstack([np.stack(part["_v"]).astype(float), np.sqrt(np.maximum(0, top - part["_sq"].to_numpy()))[:, None]])

    points = lifted(picked)
    rng = np.random.default_rng(seed)
    grown = [grow(points, leaf_size, rng) for _ in range(trees)]
    share = needed_share(grown, points, picked["vec_id"].to_numpy(), k, recall, tries, rng)
    forest = spark.sparkContext.broadcast(grown)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = lifted(part) if len(part) else np.zeros((0, 1))
            for i, tree in enumerate(forest.value if len(part) else []):
                yield pd.DataFrame({"tree": i, "leaf": tree.leaf_of(x), "_n": part["_n"]})

    # The index holds leaves and rows' numbers; vectors join it in the group step, one copy for a tree.
    leaves = stage(rows.mapInPandas(index, "tree int, leaf int, _n long"), "ann-index")
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("n")).toPandas()  # trees x leaves rows at most
    counts = [np.zeros(t.leaves, np.int64) for t in forest.value]
    for i, leaf, n in sizes.itertuples(index=False):
        counts[i][leaf] = n
    counts_shared = spark.sparkContext.broadcast(counts)
    enough = int(share * counts[0].sum()) + 2 * k * trees

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, leaf, n) for n, vec, most in zip(part["_n"], part["_v"], part["_most"], strict=True) for i, leaf in probe(forest.value, counts_shared.value, np.append(vec, 0.0), most)]
            yield pd.DataFrame(out, columns=["tree", "leaf", "_q"])

    def best(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        left = left.sort_values("vec_id", kind="stable")
        ids, x = left["vec_id"].to_numpy(), np.stack(left["_v"]).astype(float)
        first_of = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        longest = float(np.sqrt((x * x).sum(axis=1).max()))
        out = []
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            asking = np.stack(part["q"]).astype(float)
            for key, q, row in zip(part["query_id"], asking, asking @ x.T, strict=True):
                row[ids == key] = -np.inf
                # The block's product only picks, with room for its rounding, k ids; what is picked is scored in one fixed order.
                of_id = np.maximum.reduceat(row, first_of)
                least = np.partition(of_id, len(of_id) - k)[len(of_id) - k] if len(of_id) > k else -np.inf
                pick = np.flatnonzero((row >= least - 1e-12 * longest * np.linalg.norm(q)) & (row > -np.inf))
                score = inner(x[pick], q)
                order = np.lexsort((ids[pick], -score))
                pick, score = pick[order], score[order]
                _, first = np.unique(ids[pick], return_index=True)
                first = np.sort(first)[:k]
                out.append(pd.DataFrame({"query_id": key, "vec_id": ids[pick[first]], "score": score[first]}))
        return pd.concat(out)

    def search(queries: DataFrame) -> DataFrame:
        """queries (_n, query_id, _v, _most: rows to visit) -> query_id, vec_id, score: k ids at most, ranked."""
        asked = queries.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_n").mapInPandas(ask, "tree int, leaf int, _q long")
        asked = stage(asked, "ann-asked")
        # A leaf's rows are dealt into salts and its queries into blocks, group_rows each at most on average; each salt meets each block.
        asking = sizes.merge(asked.groupBy("tree", "leaf").agg(F.count("*").alias("q")).toPandas(), on=["tree", "leaf"])
        groups = spark.createDataFrame([(int(i), int(leaf), -(-int(n) // group_rows), -(-int(q) // group_rows)) for i, leaf, n, q in asking.itertuples(index=False)], "tree int, leaf int, salts int, blocks int")
        part_of = lambda key, n: F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = leaves.join(F.broadcast(groups), ["tree", "leaf"]).withColumn("salt", part_of("_n", "salts")).withColumn("block", each("blocks"))
        there = there.join(rows.select("_n", "vec_id", "_v"), "_n").select("tree", "leaf", "salt", "block", "vec_id", "_v")
        asked = asked.join(F.broadcast(groups), ["tree", "leaf"]).withColumn("block", part_of("_q", "blocks")).withColumn("salt", each("salts"))
        asked = asked.join(queries.select(F.col("_n").alias("_q"), "query_id", F.col("_v").alias("q")), "_q").select("tree", "leaf", "salt", "block", "query_id", "q")
        keys = ["tree", "leaf", "salt", "block"]
        scored = there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
        once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = rows.where(F.col("vec_id") % every == 0).select("_n", F.col("vec_id").alias("query_id"), "_v")
    found = stage(search(queries.withColumn("_most", F.lit(enough))), "ann-found")
    there_are = min(k + 1, rows.select("vec_id").distinct().limit(k + 1).count()) - 1
    full = found.groupBy("query_id").count().where(F.col("count") >= there_are).select("query_id")
    short = stage(queries.join(full, "query_id", "left_anti").withColumn("_most", F.lit(int(counts[0].sum()) * trees + 1)), "ann-short")
    if not there_are or short.isEmpty():
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(search(short))
