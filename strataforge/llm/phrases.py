"""Phrase collocation mining: mergeable Misra-Gries summaries find what can be frequent, a second pass counts it exactly.

Texts are dealt into chunks of bounded size. The first pass gives each chunk's n-grams as hash cells with their counts,
cut into hash partitions; each partition's summaries are merged under a capacity that exceeds its mass divided by the
threshold, so no n-gram with the threshold's count can be lost. A partition then tells each chunk which of the chunk's
own cells survive: no list of all survivors goes anywhere. The second pass counts the survivors of a chunk by their
words, byte by byte, and Spark sums the counts by phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stage, whole_groups
from .shingles import hash_spans, mix

#: Bytes that end a piece, and those that part its words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts in order: bytes, hashes, the text each stands in, and how far its piece goes on."""

    def __init__(self, texts: list[str], owners: np.ndarray):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.flat = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        kind = _KIND[self.flat]
        edge = np.diff((kind == 0).astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(kind == 2, dtype=np.int64)[self.starts]
        self.left = np.searchsorted(piece, piece, side="right") - np.arange(len(piece))  # words to the piece's end, itself included
        text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), self.starts, side="right")
        self.owner = owners[text] if len(owners) else np.zeros(0, np.int64)
        self.hashes = np.empty(len(self.starts), np.uint64)
        for a, b in self.runs():
            at = self.starts[a]
            self.hashes[a:b] = hash_spans(self.flat[at : self.ends[b - 1]], self.starts[a:b] - at, self.ends[a:b] - at)

    def runs(self, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of words that cover about size bytes each."""
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + size)))
            yield a, b
            a = b

    def cells(self, longest: int, seeds: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, cells) of all n-grams, n from 1 to longest: bits of a hash of their words and their owner's seed."""
        rolled = seeds[self.owner] if len(seeds) else np.zeros(0, np.uint64)
        for n in range(1, longest + 1):
            rolled = rolled[: max(0, len(self.hashes) - n + 1)]
            rolled = mix(rolled * _STEP + self.hashes[n - 1 : n - 1 + len(rolled)])
            at = np.flatnonzero(self.left[: len(rolled)] >= n)
            yield n, at, mix(rolled[at] + np.uint64(n)) >> np.uint64(64 - bits)

    def ids(self) -> tuple[np.ndarray, list[int]]:
        """A number for each word, equal for equal bytes only, and a place of each number's word."""
        _, first, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        for a, b in self.runs():
            size = self.ends[a:b] - self.starts[a:b]
            like = first[ids[a:b]]
            same = np.array_equal(size, self.ends[like] - self.starts[like])
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = same and np.array_equal(self.flat[np.repeat(self.starts[a:b], size) + inside], self.flat[np.repeat(self.starts[like], size) + inside])
            if not same:  # two words share a hash
                names: dict[bytes, int] = {}
                ids = np.array([names.setdefault(self.flat[s:e].tobytes(), len(names)) for s, e in zip(self.starts, self.ends, strict=True)])
                return ids, np.unique(ids, return_index=True)[1].tolist()
        return ids, first.tolist()

    def word(self, i: int) -> str:
        return self.flat[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte by byte: high bytes are mostly zero and shrink to nothing."""
    both = np.concatenate([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)])
    return zstandard.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.uint64), both[half:].astype(np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of several: at most capacity counters are left, and how much each may fall short by this merge."""
    keys = np.concatenate([k for k, _ in summaries])
    counts = np.concatenate([c for _, c in summaries])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    return keys[counts > cut], counts[counts > cut] - cut, cut


def survivors(blobs: list[bytes], mass: int, least: int, room: int = 8) -> np.ndarray:
    """Keys that may have a count of least or more among all summaries together; every key that has is there.

    The capacity is room times mass / least and one more, so that counters fall short by less than least / room.
    """
    capacity = room * mass // least + 1
    held, short, waiting, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, [], 0
    for blob in [*blobs, None]:
        if blob is not None:
            waiting.append(unpacked(blob))
            size += len(waiting[-1][0])
        if waiting and (blob is None or size > 2 * capacity):
            *held, cut = merged([tuple(held), *waiting], capacity)
            short, waiting, size = short + cut, [], 0
    keys, counts = held
    return keys[counts + short >= least]


def seeds_of(langs: list[str]) -> np.ndarray:
    """A 64-bit number for each language from its bytes."""
    raw = [x.encode("utf-8", "surrogatepass") for x in langs]
    flat = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(r) for r in raw], np.int64)
    return hash_spans(flat, starts, ends)


def words_of(part: pd.DataFrame) -> tuple[Words, list[str]]:
    codes, langs = pd.factorize(part["lang"])
    return Words(part["text"].tolist(), codes), list(langs)


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, chunk_chars: int = 8_000_000) -> DataFrame:
    """lang, words, phrase, f of every phrase of 1 to longest words with f >= least in its lang, and rows of words = 0 with f = all words.

    chunk_chars bounds what a task holds, not what is counted: a text longer than that is a chunk of its own.
    """
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text")).where(F.length("text") > 0)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, done = TaskContext.get().partitionId() << 32, 0
        for part in parts:
            size = part["text"].str.len().to_numpy(np.int64)
            yield part.assign(chunk=base + (done + np.cumsum(size) - size) // chunk_chars, chars=size)
            done += size.sum()

    dealt = stage(rows.mapInPandas(deal, "lang string, text string, chunk long, chars long"), "phrases-chunks")
    total = dealt.agg(F.sum("chars")).first()[0] or 0
    bits = min(63, math.ceil(math.log2(total + 2)) + 6)
    part_bits = min(bits, math.ceil(math.log2(max(partitions(spark), total / chunk_chars, 1))))
    shift = np.uint64(bits - part_bits)

    def summarise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(parts, ["chunk"]):
            for _, same in part.groupby("chunk", sort=False):
                yield summary(same)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        words, langs = words_of(part)
        keys, counts = counted(np.concatenate([c for _, _, c in words.cells(longest, seeds_of(langs), bits)]))
        part_of = (keys >> shift).astype(np.int64)
        starts = np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1])) if len(keys) else np.zeros(0, int)
        out = [(part_of[a], packed(keys[a:b], counts[a:b]), int(counts[a:b].sum())) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
        made = pd.DataFrame(out, columns=["part", "cells", "mass"])
        return made.assign(chunk=part["chunk"].iloc[0])[["chunk", "part", "mass", "cells"]]

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        """One hash partition: each chunk gets back those of its cells that survive."""
        stay = survivors(group["cells"].tolist(), int(group["mass"].sum()), least)
        out = []
        for chunk, blob in zip(group["chunk"], group["cells"], strict=True):
            keys = unpacked(blob)[0]
            at = np.searchsorted(stay, keys)
            mine = keys[stay[np.minimum(at, len(stay) - 1)] == keys] if len(stay) else keys[:0]
            if len(mine):
                out.append((chunk, packed(mine, mine * np.uint64(0))))
        return pd.DataFrame(out, columns=["chunk", "cells"])

    summaries = dealt.select("chunk", "lang", "text").mapInPandas(summarise, "chunk long, part long, mass long, cells binary")
    kept = stage(summaries.groupBy("part").applyInPandas(sift, "chunk long, cells binary"), "phrases-survivors")

    def count(_key, part: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        words, langs = words_of(part)
        out = [pd.DataFrame({"lang": langs, "words": 0, "phrase": "", "f": np.bincount(words.owner, minlength=len(langs))})]
        stay = np.sort(np.concatenate([unpacked(b)[0] for b in cells["cells"]])) if len(cells) else np.zeros(0, np.uint64)
        if len(stay):
            ids, first = words.ids()
            names: dict[int, str] = {}
            for n, at, keys in words.cells(longest, seeds_of(langs), bits):
                at = at[stay[np.minimum(np.searchsorted(stay, keys), len(stay) - 1)] == keys]
                code = words.owner[at].astype(np.int64)
                for i in range(n):
                    code = np.unique(code, return_inverse=True)[1] * np.int64(len(first)) + ids[at + i]
                _, where, f = np.unique(code, return_index=True, return_counts=True)
                place = at[where]
                rows = ids[place[:, None] + np.arange(n)].tolist()
                for row in rows:
                    for i in row:
                        if i not in names:
                            names[i] = words.word(first[i])
                phrase = [" ".join([names[i] for i in row]) for row in rows]
                out.append(pd.DataFrame({"lang": np.array(langs, object)[words.owner[place]], "words": n, "phrase": phrase, "f": f}))
        return pd.concat(out, ignore_index=True)

    counts = dealt.select("chunk", "lang", "text").groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInPandas(count, "lang string, words int, phrase string, f long")
    sums = counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stage(sums.where((F.col("words") == 0) | (F.col("f") >= least)), "phrases-frequent")


def join_words(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, scale: int = 2_000_000, cover_percent: int = 80, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each lang by how much more often they occur than their parts.

    Null and empty texts have no words; a null lang is `und`, one with a lang of that name. Repeated rows count as
    often as they occur. A lang without a frequent phrase has no rows; an empty table gives an empty one. Other columns
    are ignored. Products are decimals of 38 digits.
    """
    f = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, **options)
    found = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = found.select("lang", "phrase", "a", "words", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join_words(F.col("_w"), F.lit(1), F.col("k")).alias("_l"), join_words(F.col("_w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    part = lambda name, to: f.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"])
    score = F.expr(f"cast(cast(a as decimal(20, 0)) * {scale} div (cast(l as decimal(20, 0)) + r) as bigint)")
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: join_words(F.col("_w"), i, n))))
    inside = found.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_cover"))
    covered = F.expr(f"cast(coalesce(_cover, 0) as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {cover_percent}")
    alone = best.join(inside, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = f.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
