"""The prefix trie of conversations, rolled up by bands of depth.

A path's first d turns are named by a sum of hashes that depend on turn and depth, so prefix sums over range-sorted
chunks name every prefix of every path, however long a path is. A node is then (its smallest member, its depth): the
members' paths hold each other's nodes, and a path's own nodes, those it is the smallest member of, are its deepest
ones.

Totals of subtrees come by bands of fixed height. Inside a band each path tells its own nodes' sums to the ancestors
that stand in the same band, at most one row for each of them. The bands' roots are a tree of their own, with a depth
that is smaller by the height: it is rolled up in the same way, and the completed totals of its nodes are told to the
ancestors in the band above. So a row is told to at most `height` others, and there are log(depth) / log(height) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import running_sums, small_batches, sorted_chunks, stage, unstage

HASHES = [f"_h{i}" for i in range(4)]
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), what (digest of role and text), chars; nulls first, then by turn, equal turns by digest."""
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    role, words = text("role"), text("text")
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, words).cast("binary"))).alias("what"),
        F.length(words).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_n"), F.lit(1).cast("long").alias("_one"),
    )
    turns = stage(turns.where(F.col("conv").isNotNull()), "trie-digests")
    chunks = sorted_chunks(turns, ["conv", "turn", "what", "_n"], "trie-sorted")
    out = stage(running_sums(chunks, "conv", "_one", "_before").select("conv", (F.col("_before") + 1).alias("pos"), "what", "chars"), "trie-turns")
    unstage(turns)
    return out


def rebuilt(turns: DataFrame, step: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(steps, facts): conv, len, depth, what, chars of each rebuilt turn, and conv, len of each conversation, turnless ones too."""
    own = stage(turns.groupBy("conv").agg(F.count("*").alias("own")), "trie-lengths")
    facts = own.withColumns({"base": F.col("conv") - F.col("conv") % step, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most})
    facts = facts.join(own.select(F.col("conv").alias("base"), F.col("own").alias("_there")), "base", "left")
    facts = facts.withColumn("head", F.least("h", F.coalesce("_there", F.lit(0))))
    facts = stage(facts.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len")), "trie-facts")
    bases = turns.where((F.col("conv") % step == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "what", "chars")
    heads = facts.join(bases, "base").where("depth <= head").select("conv", "len", "depth", "what", "chars")
    tails = turns.join(facts, "conv").where("pos > h").select("conv", "len", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "what", "chars")
    return heads.union(tails), facts.select("conv", "len")


def prefix_names(steps: DataFrame) -> DataFrame:
    """Adds name, a digest of the path down to the row: the sum of 128 bits of hash that each row gives at its depth."""
    halves = {}
    for i in range(2):
        x = F.xxhash64(F.lit(i), "what", "depth")
        halves |= {HASHES[2 * i]: F.shiftrightunsigned(x, 32), HASHES[2 * i + 1]: x.bitwiseAND(F.lit(0xFFFFFFFF))}
    chunks = sorted_chunks(steps.withColumns(halves).drop("what"), ["conv", "depth"], "trie-steps")
    totals = chunks.groupBy("conv", "_chunk").agg(*[F.sum(c).alias(c) for c in HASHES])
    before = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv", "_chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start{c}") for c in HASHES])
    inside = Window.partitionBy("conv", "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = chunks.withColumns({c: F.sum(c).over(inside) for c in HASHES}).join(starts, ["conv", "_chunk"])
    name = F.unhex(F.md5(F.concat_ws(",", *[(F.col(c) + F.col(f"_start{c}")).cast("string") for c in HASHES]).cast("binary")))
    return summed.select("conv", "depth", "chars", (F.col("depth") == F.col("len")).cast("long").alias("last"), name.alias("name"))


def banded(paths: DataFrame, height: int) -> DataFrame:
    """Each row in the band of its depth, and a band's root once more at the foot of the band above."""
    band = F.expr(f"depth div {height}")
    here = paths.withColumns({"band": band, "foot": F.lit(False)})
    return here.union(paths.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).withColumns({"band": band - 1, "foot": F.lit(True)}))


#: A row's node is the path's own.
OWN = "conv = top"


def up() -> WindowSpec:
    """The rows of a path in a band, deepest first: height + 1 at most."""
    return Window.partitionBy("conv", "band").orderBy(F.desc("depth"))


def told(bands: DataFrame, counts: Column, leaves: str, saved: str) -> DataFrame:
    """top, depth, leaves, saved: what each path's own nodes that count tell every row of the path above them in the band."""
    below = up().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda c: F.sum(F.when(F.expr(OWN) & counts, F.col(c))).over(below)
    rows = bands.withColumns({"_l": value(leaves), "_s": value(saved)}).where(~F.col("foot") & F.col("_l").isNotNull())
    return rows.select("top", "depth", F.col("_l").alias("leaves"), F.col("_s").alias("saved"))


def rolled_up(paths: DataFrame, height: int, deepest: int) -> DataFrame:
    """paths (conv, depth, top, leaves, saved) -> top, depth, and the sums of leaves and saved over the node's subtree."""
    total = lambda df: df.groupBy("top", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    bands = banded(paths, height)
    inside = total(told(bands, ~F.col("foot"), "leaves", "saved"))
    if deepest < height:
        return inside
    inside = stage(inside, "trie-inside")
    at = lambda df, *names: df.select(F.col("top").alias("conv"), "depth", *[F.col(c).alias(n) for c, n in zip(("leaves", "saved"), names, strict=True)])
    # Only a path's own nodes carry values: (conv, depth) names one node, or none.
    roots = paths.where(F.col("depth") % height == 0).select("conv", "depth", "top").join(at(inside, "leaves", "saved"), ["conv", "depth"], "left")
    roots = stage(roots.select("conv", F.expr(f"depth div {height}").alias("depth"), "top", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")), "trie-roots")
    done = stage(rolled_up(roots, height, deepest // height).withColumn("depth", F.col("depth") * height), "trie-totals")
    feet = bands.select("conv", "depth", "top", "band", "foot").join(at(done, "_tl", "_ts"), ["conv", "depth"], "left")
    above = told(feet, F.col("foot"), "_tl", "_ts").where(F.col("depth") % height != 0)
    return total(inside.where(F.col("depth") % height != 0).union(above)).union(done)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """ends (top, depth, conv) -> top, depth, sha: SHA-256 of the ids in order, comma-joined.

    Ids are joined in range-sorted chunks first; where a node's ids lie in several chunks, their texts are hashed one
    after another, and no text of all of them is ever made.
    """
    chunks = sorted_chunks(ends, ["top", "depth", "conv"], "trie-ends")
    texts = chunks.groupBy("top", "depth", "_chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    texts = stage(texts, "trie-texts")
    nodes = texts.groupBy("top", "depth").agg(F.count("*").alias("k"), F.first("ids").alias("ids"))
    once = nodes.where("k = 1").select("top", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    several = texts.join(nodes.where("k > 1").select("top", "depth"), ["top", "depth"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for top, depth, ids in zip(part["top"], part["depth"], part["ids"], strict=True):
                if (top, depth) != now:
                    out += [(*now, state.hexdigest())] if now else []
                    now, state = (top, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pd.DataFrame(out, columns=["top", "depth", "sha"])
        if now:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["top", "depth", "sha"])

    streamed = several.repartition("top", "depth").sortWithinPartitions("top", "depth", "_chunk").select("top", "depth", "ids").mapInPandas(run, "top long, depth long, sha string")
    return once.union(streamed)


def prefix_trie(conversations: DataFrame, *, step: int = 100, most: int = 6, height: int = 32) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, its subtree's totals included.

    Rows without conv_id belong to no conversation and are left out. A null turn comes first; equal turns are ordered
    by a digest of role and text; repeated rows are turns each. A null role or text is empty. An empty table has no
    node, not even a root. Other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(conversations)
    turns = ordered_turns(conversations)
    steps, facts = rebuilt(turns, step, most)
    top = facts.agg(F.min("conv"), F.count("*"), F.sum((F.col("len") == 0).cast("long")), F.max("len")).first()
    if top[0] is None:
        return spark.createDataFrame([], OUT)
    names = stage(prefix_names(steps), "trie-paths")
    unstage(turns)
    nodes = stage(names.groupBy("depth", "name").agg(F.min("conv").alias("top"), F.count("*").alias("n"), F.sum("last").alias("_ends")), "trie-nodes")
    value = {"leaves": (F.col("n") == F.col("_ends")).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")}
    columns = ["conv", "depth", "top", "n", "leaves", "saved", "last"]
    deep = names.join(nodes, ["depth", "name"]).withColumns(value).select(*columns)
    root = facts.select("conv", *[F.lit(x).cast("long").alias(c) for c, x in zip(columns[1:], (0, top[0], top[1], top[1] == top[2], 0), strict=False)], (F.col("len") == 0).cast("long").alias("last"))
    paths = stage(deep.union(root), "trie-tops")
    unstage(names, nodes)

    kin = banded(paths, height).withColumns({"parent": F.lead("top").over(up()), "child": F.lag(F.expr(OWN)).over(up())})
    below = F.col("foot") | (F.col("depth") % height != 0) | (F.col("depth") == 0)
    wide = lambda df, **c: df.select("conv_id", "depth", *[c.get(x, F.lit(None)).cast("string" if x == "sha" else "long").alias(x) for x in ("parent", "n", "children", "leaves", "saved", "sha")])
    own = wide(kin.where(F.expr(OWN) & below).withColumn("conv_id", F.col("conv")), parent=F.col("parent"), n=F.col("n"))
    children = wide(kin.where(~F.col("foot") & F.col("child")).withColumn("conv_id", F.col("top")), children=F.lit(1))
    totals = wide(rolled_up(paths.select("conv", "depth", "top", "leaves", "saved"), height, top[3]).withColumnRenamed("top", "conv_id"), leaves=F.col("leaves"), saved=F.col("saved"))
    hashes = wide(hashed_ends(paths.where("last = 1").select("top", "depth", "conv")).withColumnRenamed("top", "conv_id"), sha=F.col("sha"))
    facts_of = own.union(children).union(totals).union(hashes).groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("sha"), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return facts_of.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
