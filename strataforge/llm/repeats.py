"""Removal of long repeated byte strings, by ranks of thinned positions.

Prefix doubling, which ranks every position, was measured: one round moves 34 times the stored text (README). It is
replaced: no pairs of ranks are doubled or sorted. The positions are thinned first, losing nothing:

* Anchors. Of the 64-byte strings inside any `length`-byte window, the least by hash (the first among equals) is the
  window's anchor. Equal windows have equal anchors at equal places, so it is enough to rank anchors.
* Round 1 ranks anchors by their 64 bytes and keeps those whose rank is shared.
* Round 2 takes ranks at growing offsets around an anchor: the windows of one anchor fall into blocks of up to 42
  neighbouring starts. A block's core is what all its windows have in common, its hull what they cover together. If no
  other position shares the core, the block is done: all unique. If one shares the hull, it is done: all repeated.
* Round 3 ranks single windows where cores are shared and hulls are not, the edges of repeated runs.

A rank is a 63-bit hash of the string's bytes and counts of ranks stand in for sorted neighbours; each round is a Spark
aggregation whose partial sums keep frequent strings from meeting in one task. Texts are stored once for each different
text, bucketed by key, so that rounds move positions and never texts.

The same rounds also find the passages of `words` words that other documents hold, which may be shorter than `length`
bytes: there the units are hashes of words, and the last bit of a rank tells words (1) from bytes (0). Strings of bytes
must stand at two places, those of words in two different texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, unstage, word_count
from .shingles import SPACE, mix, powers_to

GRAM, BLOCK, CHUNK = 64, 42, 1 << 22
WORD_GRAM, WORD_BLOCK = 8, 11
U = np.uint64


class Rolling:
    """Hashes of any range of units (bytes, or hashes of words) of one piece of text, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers_to(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, U(0xFFFFFFFFFFFFFFFF))
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def word_units(raw: bytes) -> np.ndarray:
    """A hash of each word of a text, chunk by chunk; no chunk ends inside a word."""
    flat = np.frombuffer(raw, np.uint8)
    found, at = [np.zeros(0, U)], 0
    while at < len(flat):
        end = at + CHUNK
        if end < len(flat):
            gaps = np.flatnonzero(SPACE[flat[at:end]])
            after = SPACE[flat[end:]] if not len(gaps) else None
            end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(after.argmax()) if after.any() else len(flat)
        part = flat[at:end]
        edges = np.flatnonzero(np.diff(~SPACE[part], prepend=False, append=False))
        found.append(Rolling(part).of(edges[::2], edges[1::2]))
        at = end
    return np.concatenate(found)


def pieces(flat: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """The text in chunks that overlap by length - 1, so that each window lies in just one of them."""
    for at in range(0, max(1, len(flat) - length + 1), CHUNK):
        yield at, flat[at : at + CHUNK + length - 1]


def unit_anchors(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of its gram units, place, first and last start of the windows it anchors) for each anchor of a text."""
    found = []
    for at, flat in pieces(units, length):
        if len(flat) < length:
            continue
        grams = len(flat) - gram + 1
        start = np.arange(grams)
        rank = Rolling(flat).of(start, start + gram)
        # 40 bits of hash, then the place: the first of equals is the least.
        least = sliding_least(rank >> U(24) << U(24) | start.astype(U), length - gram + 1) & U(0xFFFFFF)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        place = least[first].astype(np.int64)
        found.append((rank[place], place + at, first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    if len(found) == 1:
        return found[0]
    rank, place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # An anchor whose windows lie on both sides of a chunk's edge is one anchor.
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return rank[new], place[new], first[new], last[np.append(new[1:], len(place)) - 1]


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """unit_anchors of a text's bytes."""
    return unit_anchors(np.frombuffer(raw, np.uint8), length, GRAM)


def tagged(rank: np.ndarray, view: int) -> np.ndarray:
    """Ranks as signed numbers whose last bit tells words from bytes."""
    return (rank & ~U(1) | U(view)).view(np.int64)


def blocks(units: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, block: int, view: int) -> dict[str, np.ndarray]:
    """The blocks of some anchors: core and hull ranks (hull 0: it leaves the text), and the block's starts."""
    near, far = place - last, place - first  # distances from a start to its anchor
    q0, q1 = near // block, far // block
    n = q1 - q0 + 1
    which = np.repeat(np.arange(len(place)), n)
    q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + q0[which]
    p = place[which]
    low, high = q * block, q * block + block - 1
    rolling = Rolling(units)
    core = rolling.of(p - low, p + length - high)
    inside = (p - high >= 0) & (p - low + length <= len(units))
    hull = rolling.of(np.where(inside, p - high, 0), np.where(inside, p - low + length, 0))
    salt = mix(q.astype(U) + U(77))
    return {
        "core": tagged(core ^ salt, view),
        "hull": np.where(inside, hull ^ salt, U(0)).view(np.int64),
        "lo": np.maximum(first[which], p - high),
        "hi": np.minimum(last[which], p - low),
    }


def text_table(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame, str]:
    """Per row: doc_id, key, size, own digest; and the name of the bucketed table of different texts that can hold a repeat."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text, F.lit(5)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    texts = docs.select(F.xxhash64(text, F.lit(5)).alias("key"), text.alias("text")).where(F.octet_length("text") >= least)
    once = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    once.write.bucketBy(partitions(spark), "key").option("compression", "zstd").format("parquet").saveAsTable(name)
    return stage(rows, "repeat-rows"), spark.table(name), name


def framed(found: list[tuple[int, dict]]) -> pd.DataFrame:
    """What was found in some texts, (key, columns) for each, as one frame."""
    size = [len(next(iter(c.values()))) for _, c in found]
    return pd.DataFrame({"key": np.repeat([k for k, _ in found], size)} | {n: np.concatenate([c[n] for _, c in found]) for n in found[0][1]})


def in_frames(found: Iterator[tuple[int, dict]]) -> Iterator[pd.DataFrame]:
    """Frames of up to 256 texts or some 50,000 rows."""
    kept, n = [], 0
    for one in found:
        kept.append(one)
        n += len(next(iter(one[1].values())))
        if len(kept) >= 256 or n > 50_000:
            yield framed(kept)
            kept, n = [], 0
    if kept:
        yield framed(kept)


def with_texts(texts: DataFrame, sides: DataFrame, work, schema: str) -> DataFrame:
    """sides (key, at: whole numbers, see at_key) meet their text where it lies; work(raw, at) gives columns for each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from in_frames((key, work(text.encode("utf-8", "surrogatepass"), at)) for key, text, at in zip(part["key"], part["text"], part["at"], strict=True))

    return texts.select("key", "text").join(sides.hint("shuffle_hash"), "key").mapInPandas(run, schema)


def at_key(df: DataFrame, *names: str) -> DataFrame:
    """The rows of each key as one array: view and names of the first row, of the second, and so on."""
    return df.groupBy("key").agg(F.flatten(F.collect_list(F.array(F.col("view").cast("long"), *names))).alias("at"))


def by_view(at: np.ndarray, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of at_key's rows: for bytes (0), then for words (1), where there are any."""
    rows = np.asarray(at, np.int64).reshape(-1, width + 1)
    for view in (0, 1):
        own = rows[rows[:, 0] == view]
        if len(own):
            yield view, list(own[:, 1:].T)


def units_of(raw: bytes, view: int) -> np.ndarray:
    return word_units(raw) if view else np.frombuffer(raw, np.uint8)


def view_of(rank: str) -> Column:
    return F.col(rank).bitwiseAND(F.lit(1))


def owner(rank: str, place: str) -> Column:
    """Two strings are repeats of each other if they have different owners: the place of bytes, the text of words."""
    return F.when(view_of(rank) == 1, F.col("key")).otherwise(F.col("key").bitwiseXOR(F.col(place)))


def shared_ranks(ranks: DataFrame, key: str, place: str) -> DataFrame:
    """The ranks with more than one owner, written: a join with them is dealt anew, so that Spark can split a common rank's rows."""
    owners = ranks.groupBy(key).agg(F.min(owner(key, place)).alias("_a"), F.max(owner(key, place)).alias("_b"))
    return stage(owners.where("_a < _b").select(key), f"repeat-shared-{key}")


def starts_in(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All starts of some ranges, each once, in order."""
    n = hi - lo + 1
    return np.unique(np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n))


def stacked(parts: list[dict]) -> dict:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def repeated_ranges(texts: DataFrame, length: int, words: int) -> DataFrame:
    """(key, view, lo, hi): every start from lo to hi begins a window that starts elsewhere too.

    Of equal windows of words in one text, one at least is told.
    """
    sizes, block = (length, words), (BLOCK, WORD_BLOCK)

    def first_ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(raw: bytes) -> dict:
            both = anchors(raw, length), unit_anchors(word_units(raw), words, WORD_GRAM)
            return stacked([{"rank": tagged(rank, view), "place": place, "first": first, "last": last} for view, (rank, place, first, last) in enumerate(both)])

        for part in parts:
            yield from in_frames((key, found(text.encode("utf-8", "surrogatepass"))) for key, text in zip(part["key"], part["text"], strict=True))

    found = stage(texts.select("key", "text").mapInPandas(first_ranks, "key long, rank long, place long, first long, last long"), "repeat-anchors")
    shared = shared_ranks(found, "rank", "place")
    open_ = found.join(shared, "rank").withColumn("view", view_of("rank"))

    def second(raw: bytes, at) -> dict:
        return stacked([blocks(units_of(raw, view), *own, sizes[view], block[view], view) for view, own in by_view(at, 3)])

    rows = stage(with_texts(texts, at_key(open_, "place", "first", "last"), second, "key long, core long, hull long, lo long, hi long"), "repeat-blocks")
    unstage(found, shared)
    # One entry for each different hull of a core; a block whose hull leaves the text is an entry of its own.
    entry = F.when(F.col("hull") != 0, F.col("hull")).otherwise(F.xxhash64("key", "lo", F.lit(3)))
    who = owner("core", "lo")
    entries = stage(rows.groupBy("core", entry.alias("entry")).agg(F.min(who).alias("a"), F.max(who).alias("b"), F.min(F.struct("key", "lo", "hi")).alias("one")), "repeat-entries")
    whole = rows.join(entries.where("a < b").select("core", "entry"), (rows["core"] == entries["core"]) & (entry == F.col("entry")), "left_semi").select("key", view_of("core").alias("view"), "lo", "hi")
    open_cores = stage(entries.groupBy("core").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("n > 1 and a < b").select("core"), "repeat-shared-core")
    edges = entries.join(open_cores, "core").select("one.*", view_of("core").alias("view"))

    def third(raw: bytes, at) -> dict:
        out = []
        for view, own in by_view(at, 2):
            start = starts_in(*own)
            out.append({"rank": tagged(Rolling(units_of(raw, view)).of(start, start + sizes[view]), view), "start": start})
        return stacked(out)

    windows = stage(with_texts(texts, at_key(edges, "lo", "hi"), third, "key long, rank long, start long"), "repeat-windows")
    single = windows.join(shared_ranks(windows, "rank", "start"), "rank").select("key", view_of("rank").alias("view"), F.col("start").alias("lo"), F.col("start").alias("hi"))
    return whole.union(single)


def spans(lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes that the windows from lo to hi cover: [[start, end], …]."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    first = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return np.stack([lo[first], end[np.append(first[1:], len(lo)) - 1]], axis=1)


def passage_words(raw: bytes, lo: np.ndarray, hi: np.ndarray, words: int) -> int:
    """Words of a text in windows that equal one of those from lo to hi."""
    units = word_units(raw)
    start = np.arange(len(units) - words + 1)
    rank = Rolling(units).of(start, start + words)
    told = np.flatnonzero(np.isin(rank, rank[starts_in(lo, hi)]))
    return int(np.diff(spans(told, told, words), axis=1).sum())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 51, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay), n_passage_words.

    A byte goes if a string of `length` bytes over it also starts anywhere else in the table, judged on the input. Null
    texts are empty; a text shorter than length keeps everything; a text that stands on two rows and is long enough
    loses everything on both. An empty table gives an empty one; other columns are ignored. Different texts are told
    apart by 64-bit keys.

    n_passage_words: words (runs of anything but ASCII white space, as they are written) of the row's text in passages of
    `words` words that another row's text holds too. They are counted whether or not their bytes go: a passage shorter
    than `length` bytes stays.
    """
    spark = docs.sparkSession
    rows, texts, name = text_table(docs, id_col, text_col, min(length, 2 * words - 1))
    ranges = repeated_ranges(texts, length, words)

    def last(raw: bytes, at) -> dict:
        own = dict(by_view(at, 2))
        cut = spans(*own[0], length) if 0 in own else np.zeros((0, 2), np.int64)
        edges = [0, *cut.ravel().tolist(), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        found = passage_words(raw, *own[1], words) if 1 in own else 0
        return {"n_removed": [len(raw) - len(kept)], "n_spans": [len(cut)], "sha": [hashlib.sha256(kept).hexdigest()], "kept": np.array([kept if with_text else None], object), "passages": [found]}

    changed = with_texts(texts, at_key(ranges, "lo", "hi"), last, "key long, n_removed long, n_spans long, sha string, kept binary, passages long")
    of_text = word_count(F.col("text"))
    copies = texts.where("copies > 1").select("key", F.when(F.octet_length("text") >= length, True).alias("copied"), F.when(of_text >= words, of_text).alias("all_words"))
    result = rows.join(stage(changed, "repeat-changed"), "key", "left").join(stage(copies, "repeat-copies"), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = result.select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), nothing).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
        F.coalesce("all_words", "passages", F.lit(0)).cast("long").alias("n_passage_words"),
        *([F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    spark.sql(f"DROP TABLE {name}")
    return out
