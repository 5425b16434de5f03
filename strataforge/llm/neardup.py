"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

Equal shingle sets are one class, and classes are what is compared. A sketch keeps, for each of 128 buckets, the leading
zeros and ten mantissa bits of the bucket's least hash. Bands of four registers make buckets of candidates:

1. every class meets the smallest class of all its buckets; pairs whose collision-corrected estimate may reach the
   threshold are confirmed on their full sets, and confirmed pairs give components;
2. where a bucket still holds several components, its members' registers meet in blocks; each block ties components with
   some pair that may link into families, by a union-find of its own, and gives at most one row fewer than it has members;
3. the full sets of a family meet in blocks, are counted against each other there, and again a block gives at most one
   link fewer than it has members.

So rows follow documents, never pairs, however large a group is and however near the threshold it lies; comparisons in
excess of that are arithmetic inside a block. No link between different texts is lost but by all 32 bands missing it
(about 1e-10 at the threshold of 0.85).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, partitions, slices, stage, unstage
from .components import components, merged
from .shingles import mix, shingle_sets

BUCKET_BITS, MANTISSA, BANDS = 7, 10, 32
BUCKETS, ROWS = 1 << BUCKET_BITS, (1 << BUCKET_BITS) // BANDS
EMPTY = np.uint16(0xFFFF)
#: Keys up to this many (24 bytes each) are broadcast to pick rows; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A block holds about so many members, and so many shingles, of either side.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of a sorted set of hashes; a bucket's least hash is its first."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rest = (shingles[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits
        length = np.frexp(rest.astype(float))[1]
        zeros = np.where(rest > 0, 53 - length, 53).astype(np.uint64)
        mantissa = np.where(rest > 0, (rest << (zeros + np.uint64(12))) >> np.uint64(64 - MANTISSA), np.uint64(0))
        out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def collision(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that two different least hashes share a register: equal leading zeros, then equal mantissas."""
    k = np.arange(40)
    tail = lambda n: 1 - (1 - 2.0 ** -k[None, :]) ** (np.maximum(n, BUCKETS)[:, None] / BUCKETS)
    a, b = tail(na), tail(nb)
    pa, pb = a - np.append(a[:, 1:], np.zeros((len(a), 1)), axis=1), b - np.append(b[:, 1:], np.zeros((len(b), 1)), axis=1)
    return (pa * pb).sum(axis=1) / (1 << MANTISSA)


def may_link(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes rule a link out or the corrected estimate lies six deviations below the threshold."""
    out = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    at = np.flatnonzero(out)
    ra, rb = ra[at], rb[at]
    equal, filled = ra == rb, ra != EMPTY
    n = np.maximum((filled | (rb != EMPTY)).sum(axis=1), 1)
    share, t = (equal & filled).sum(axis=1) / n, percent / 100
    least = t - 6 * np.sqrt(t * (1 - t) / n)
    near = np.flatnonzero(share >= least)  # correcting only lowers a share
    c = collision(na[at[near]], nb[at[near]])
    out[:] = False
    out[at[near[(share[near] - c) / (1 - c) >= least[near]]]] = True
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, key) for each band that isn't all empty."""
    grouped = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(regs), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + grouped[:, :, i])
    row, band = np.nonzero((grouped != np.uint64(EMPTY)).any(axis=2))
    return row, band, key[row, band].view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, t (the text's hash), n, two 64-bit signatures of the set, and its registers."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part in slices(whole):
                sets = shingle_sets(part["_text"].tolist(), words)
                salted = [mix(s + np.uint64(0x632BE59BD9B4E019)) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": part["_id"].values,
                        "t": part["_t"].values,
                        "n": [len(s) for s in sets],
                        "sig_a": np.array([x.sum(dtype=np.uint64) for x in salted], np.uint64).view(np.int64),
                        "sig_b": np.array([mix(x).sum(dtype=np.uint64) for x in salted], np.uint64).view(np.int64),
                        "regs": [registers(s).tobytes() for s in sets],
                    }
                )

    text = docs[text_col]
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    return rows.mapInPandas(work, "doc_id long, t long, n long, sig_a long, sig_b long, regs binary")


def stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), BUCKETS)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that may link, by their registers."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.loc[may_link(stacked(part["ra"]), stacked(part["rb"]), part["na"].to_numpy(), part["nb"].to_numpy(), percent), ["a", "b"]]

    return both.mapInPandas(work, "a long, b long")


def full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, name: str) -> DataFrame:
    """(c, s) for classes (c, rep, t): the shingle set of each one's text; only those texts are read into sets."""
    wanted = wanted.withColumnsRenamed({"rep": "_rep", "t": "_t"})
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, (F.xxhash64("_text") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_rep")))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part in slices(whole):
                yield pd.DataFrame({"c": part["c"].values, "s": [s.tobytes() for s in shingle_sets(part["_text"].tolist(), words)]})

    return stage(texts.select("c", "_text").mapInPandas(work, "c long, s binary"), name)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that link on their full sets.

    A hub's members are dealt out in chunks, each of which gets the hub's set once and then streams the members.
    """
    dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(64)))
    members = dealt.join(sets.withColumnRenamed("c", "b"), "b").select("a", "chunk", F.lit(1).alias("member"), "b", "s")
    hubs = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("c", "a"), "a").select("a", "chunk", F.lit(0).alias("member"), F.col("a").alias("b"), "s")
    rows = members.union(hubs).repartition(partitions(pairs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "member")

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = None
        for part in parts:
            good = []
            for a, member, b, s in zip(part["a"], part["member"], part["b"], part["s"], strict=True):
                s = np.frombuffer(s, np.uint64)
                if not member:
                    hub = s
                    continue
                small, large = (s, hub) if len(s) < len(hub) else (hub, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if 100 * shared >= percent * (len(s) + len(hub) - shared):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(check, "a long, b long")


def in_blocks(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) of its group that its own block, `mine`, is in."""
    mine = F.pmod(F.xxhash64("c", group), F.col(blocks)).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", blocks)


class Forest:
    """A union-find over 0 … n - 1 whose labels can be read all at once."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1] if len(labels) else labels
        self.links: list[tuple[int, int]] = []

    def tie(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == y] = x
            self.links.append((a, b))


def families(placed: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From placed (h, c, comp): the rows of buckets with several components, and ties (a, b) of components with a pair that may link."""
    spark = placed.sparkSession
    sizes = placed.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = sizes.where("low < high").select("h", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    open_ = stage(placed.join(mixed, "h"), "near-open")
    dealt = in_blocks(open_, "h", "blocks").join(classes.select("c", "n", "regs"), "c")
    rows = dealt.repartition(partitions(spark), "h", "i", "j").sortWithinPartitions("h", "i", "j", "c")

    def ties(part: pd.DataFrame) -> pd.DataFrame:
        comp, n, mine, regs = part["comp"].to_numpy(), part["n"].to_numpy(), part["mine"].to_numpy(), stacked(part["regs"])
        crossed, forest = part["i"].iloc[0] != part["j"].iloc[0], Forest(comp)
        for d in range(1, len(part)):
            if (forest.label == forest.label[0]).all():
                break
            at = np.flatnonzero((forest.label[d:] != forest.label[:-d]) & ((mine[d:] != mine[:-d]) if crossed else True))
            for p in (at[may_link(regs[at], regs[at + d], n[at], n[at + d], percent)] if len(at) else at).tolist():
                forest.tie(p, p + d)
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": comp[links[:, 0]], "b": comp[links[:, 1]]})

    return open_, rows.mapInPandas(by_group(ties, ["h", "i", "j"]), "a long, b long")


def linked(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join components of one block, counted on full sets; at most one fewer than there are members."""
    c, mine, sets = part["c"].to_numpy(), part["mine"].to_numpy(), [np.frombuffer(s, np.uint64) for s in part["s"]]
    crossed, forest = part["i"].iloc[0] != part["j"].iloc[0], Forest(part["comp"].to_numpy())
    n = np.array([len(s) for s in sets])
    theirs = np.flatnonzero(mine == mine.max()) if crossed else np.arange(len(c))
    ours = np.flatnonzero(mine != mine.max()) if crossed else theirs
    if len(ours) and len(theirs):
        word = np.concatenate([sets[k] for k in theirs])
        order = np.argsort(word, kind="stable")
        word, owner = word[order], np.repeat(theirs, n[theirs])[order]
        for k in ours.tolist():
            fits = (forest.label != forest.label[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            if not fits[theirs if crossed else theirs[k + 1 :]].any():
                continue
            first, last = np.searchsorted(word, sets[k], "left"), np.searchsorted(word, sets[k], "right")
            run = last - first
            at = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run) + np.repeat(first, run)
            shared = np.bincount(owner[at], minlength=len(c))
            for other in np.flatnonzero(fits & (100 * shared >= percent * (n + n[k] - shared))).tolist():
                forest.tie(k, other)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": c[links[:, 0]], "b": c[links[:, 1]]})


def with_components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, t, n, component_id."""
    spark = docs.sparkSession
    flat = stage(sketches(docs, id_col, text_col, words), "near-sketches")
    by_set = flat.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("x"), F.first("regs").alias("regs"))
    # A class is one shingle set; its number holds from here on because the rows are written.
    classes = stage(by_set.select(F.monotonically_increasing_id().alias("c"), "n", "sig_a", "sig_b", F.col("x.doc_id").alias("rep"), F.col("x.t").alias("t"), "regs"), "near-classes")

    def to_bands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                row, _, key = band_keys(stacked(part["regs"]))
                yield pd.DataFrame({"h": key, "c": part["c"].to_numpy()[row]})

    bands = stage(classes.select("c", "regs").mapInPandas(to_bands, "h long, c long"), "near-bands")
    comps = spark.createDataFrame([], "id long, component long")

    def settle(links: DataFrame) -> None:
        """Merges the components that links tie."""
        nonlocal comps
        new, old = stage(links, "near-links"), comps
        if not new.isEmpty():
            comps = merged(comps, new)
            if hasattr(old, "_staged_path"):
                unstage(old)
        unstage(new)

    # Rows that share an id are one node, whatever their sets are.
    repeated = stage(flat.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("sig_a").alias("low"), F.max("sig_a").alias("high")).where("low < high").select("doc_id"), "near-repeated")
    if not repeated.isEmpty():
        of_id = flat.where("n > 0").join(repeated, "doc_id").join(classes.select("c", "n", "sig_a", "sig_b"), ["n", "sig_a", "sig_b"]).select("doc_id", "c")
        settle(of_id.join(of_id.groupBy("doc_id").agg(F.min("c").alias("a")), "doc_id").select("a", F.col("c").alias("b")).where("a <> b").distinct())

    # Both sides are written, so that the rows of a band that a common passage fills can be split.
    hubs = stage(bands.groupBy("h").agg(F.min("c").alias("hub"), F.count("*").alias("m")).where("m > 1").select("h", "hub"), "near-hubs")
    shared = stage(bands.join(hubs, "h"), "near-shared")
    unstage(bands, hubs)
    met = shared.where("c <> hub").groupBy(F.col("c").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    pairs = stage(estimated(met, classes, percent), "near-pairs")
    keys = classes.select("c", "rep", "t")
    if not pairs.isEmpty():
        ends = stage(keys.join(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "c", "left_semi"), "near-ids")
        sets = full_sets(ends, docs, id_col, text_col, words, "near-sets")
        settle(confirmed(pairs, sets, percent))
        unstage(ends, sets)
    unstage(pairs)
    placed = shared.join(comps, shared["c"] == comps["id"], "left").select("h", "c", F.coalesce("component", "c").alias("comp"))
    open_, ties = families(placed, classes, percent)
    ties = stage(ties, "near-ties")
    if not ties.isEmpty():
        family = components(ties, "near-families").withColumnsRenamed({"id": "comp", "component": "family"})
        members = stage(open_.select("c", "comp").distinct().join(family, "comp").join(classes.select("c", "n", "rep", "t"), "c"), "near-members")
        sets = full_sets(members.select("c", "rep", "t"), docs, id_col, text_col, words, "near-family-sets")
        size = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        dealt = in_blocks(members.select("family", "comp", "c").join(size, "family"), "family", "blocks").join(sets, "c")
        rows = dealt.repartition(partitions(spark), "family", "i", "j").sortWithinPartitions("family", "i", "j", "c")
        settle(rows.mapInPandas(by_group(lambda part: linked(part, percent), ["family", "i", "j"]), "a long, b long"))
        unstage(members, sets)
    unstage(shared, open_, ties)
    where = classes.join(comps, classes["c"] == comps["id"], "left").select("n", "sig_a", "sig_b", "rep", F.coalesce("component", "c").alias("comp"))
    where = where.join(where.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("n", "sig_a", "sig_b", "component_id")
    where = stage(where, "near-where")  # copies of one text may be many: written, they can be split
    out = flat.select("doc_id", "t", "n", "sig_a", "sig_b").join(where, ["n", "sig_a", "sig_b"], "left")
    return out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id linked, itself included), kept (doc_id = component_id).

    Texts link where 100 * shared shingles >= percent * all shingles of the two. A text with fewer words is one shingle;
    null, empty and blank texts have none and link with nothing. Rows that share an id are one node, by any of their
    texts with words. Rows without an id link like others, have the least id linked, or null, and are kept only in the
    latter case. An empty table gives an empty one; other columns are ignored.
    """
    out = with_components(docs, id_col, text_col, words, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs (doc_id, text and others), all columns: one document of each component.

    Null, empty and blank texts stay. Of rows that share a kept id one stays for each different text; rows without an id
    stay where no row with an id is linked with them, again one for each text. An empty table gives an empty one.
    """
    flat = stage(with_components(docs, "doc_id", "text", words, percent), "near-rows")
    key = (F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))) & (F.xxhash64("text") == F.col("_t"))

    def keys(rows: DataFrame, name: str) -> DataFrame:
        out = stage(rows.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).distinct(), name)
        return F.broadcast(out) if out.count() <= BROADCAST_IDS else out

    kept = docs.join(keys(flat.where("not (doc_id <=> component_id)"), "near-dropped"), key, "left_anti")
    again = keys(flat.groupBy("doc_id", "t").agg(F.count("*").alias("m")).where("m > 1"), "near-again")
    if again.isEmpty():
        return kept
    same = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # rows that differ in order of their columns
    first = kept.join(again, key, "left_semi").withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*same))).where("_row = 1")
    return kept.join(again, key, "left_anti").union(first.select(*docs.columns))
