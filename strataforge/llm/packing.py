"""Best-fit packing by minimum bin slack.

Pieces differ, for packing, in their length alone, and there are at most `capacity` lengths. So one histogram, of fixed
size, describes any corpus. Bin after bin takes the longest piece left and, by a subset-sum over bit sets, the fullest
combination of other lengths beside it; that bin is repeated as often as the histogram allows and its pieces are taken
off. Each such pattern uses a length up, so patterns stay about as few as lengths. Pieces are then numbered within
their length (distributed) and join the pattern that holds their number.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_sums, slices, small_batches, sorted_chunks, stage
from .shingles import hash_spans

PIECES = "piece int, start long, length int, ids array<int>, ids_crc32 long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is: in the folder TOKENIZERS_DIR if that is set, else where its package says."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill the capacity best (longer pieces first among equals), by a bit-set subset sum."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, size = left - take, size * 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of such bins), until the histogram is used up."""
    counts, out = {k: v for k, v in histogram.items() if v}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        bin_ = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in bin_.items())
        out.append((bin_, times))
        for k, v in bin_.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return out


class Words:
    """Ids of words by the words' hashes, in sorted arrays: some 40 bytes a word, where a dictionary took some 200."""

    def __init__(self) -> None:
        self.clear()

    def __len__(self) -> int:
        return len(self.hashes)

    def clear(self) -> None:
        self.hashes, self.pool = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are not known."""
        if not len(self):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.flatnonzero(self.hashes[at] != hashes)

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """hashes are sorted and new."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        first = len(self.pool) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.sizes = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.first, first), (self.sizes, sizes)))
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))

    def ids(self, hashes: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words hashes[back], one after another, and where each word's end."""
        at = np.searchsorted(self.hashes, hashes)[back]
        n = self.sizes[at]
        done = np.cumsum(n)
        return self.pool[np.repeat(self.first[at] - (done - n), n) + np.arange(int(n.sum()))], done


def tokenizer(path: str) -> tuple:
    """The vocabulary at path, which of its ids end a word, and the words encoded so far: once in each worker process.

    A task's functions arrive with globals of their own, so what outlives a task is kept with the interpreter.
    """
    kept = sys.modules.setdefault("_strataforge_tokenizers", types.ModuleType("_strataforge_tokenizers")).__dict__
    if path not in kept:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        vocabulary = model.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        kept[path] = (model, ends, Words())
    return kept[path]


#: Stands between words that are encoded together; a word that holds it is encoded alone.
FENCE = "\ue000"
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
ANY_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True


def encode_words(model, ends: np.ndarray, new: list[str]) -> list[bytes]:
    """Ids (little-endian, 32 bits) of each word, many encoded in one text.

    A word of Latin letters alone gives one run of ids with one word end; others are told apart by the fence's ids.
    """
    plain = [w.isalpha() and max(w) < "\u0250" for w in new]
    out: list[bytes] = [b""] * len(new)
    for easy in (True, False):
        rows = [i for i, p in enumerate(plain) if p == easy]
        for at in range(0, len(rows), 2000):
            part = rows[at : at + 2000]
            found = letters(model, ends, [new[i] for i in part]) if easy else fenced(model, [new[i] for i in part])
            for i, ids in zip(part, found, strict=True):
                out[i] = ids
    return out


def one_text(model, text: str) -> np.ndarray:
    return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def letters(model, ends: np.ndarray, words: list[str]) -> list[bytes]:
    ids = one_text(model, " ".join(words))
    edge = np.flatnonzero(ends[ids]) + 1
    if len(edge) != len(words):
        return fenced(model, words)
    return [ids[a:b].tobytes() for a, b in zip([0, *edge[:-1].tolist()], edge.tolist(), strict=True)]


def fenced(model, words: list[str]) -> list[bytes]:
    if any(FENCE in w for w in words):
        return [one_text(model, w).tobytes() for w in words]
    fence = one_text(model, FENCE)
    ids = one_text(model, f" {FENCE} ".join(words) + f" {FENCE}")
    here = np.ones(max(0, len(ids) - len(fence) + 1), bool)
    for i, x in enumerate(fence):
        here &= ids[i : len(ids) - len(fence) + 1 + i] == x
    edge = np.flatnonzero(here)
    return [ids[a:b].tobytes() for a, b in zip([0, *(edge[:-1] + len(fence)).tolist()], edge.tolist(), strict=True)]


def at_spaces(joined: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes that end behind white space; joined ends with a space, a longer word stays whole."""
    start = 0
    while start < len(joined):
        end = ANY_SPACE.search(joined, min(start + size, len(joined)) - 1).end()
        yield start, end
        start = end


def encode_texts(texts: list[str], path: str, *, remember: int = 300_000, size: int = 1 << 18) -> list[np.ndarray]:
    """Ids of each text.

    The vocabulary lowers case, drops white space and parts a letter from the stop after it, so each different word is
    encoded once and texts are put together from words, told apart by 64-bit hashes. size bounds the bytes looked at
    together, whether of many texts or of a part of one, remember the words kept; beyond it the memory starts anew.
    Texts that may hold a special token's name are encoded whole.
    """
    model, ends_word, known = tokenizer(path)
    raw = [_FLAT[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)].tobytes() if "<|" not in t else b"" for t in texts]
    joined = b" ".join(raw) + b" "
    edges = np.cumsum([len(r) + 1 for r in raw])[:-1] if raw else np.zeros(0, np.int64)
    found, places, n_ids = [], [], 0
    for low, high in at_spaces(joined, size):
        flat = np.frombuffer(joined, np.uint8, high - low, low)
        inside = ~_SPACE[flat]
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        cut = _STOP[flat] & np.append(False, _LETTER[flat[:-1]]) & ~after
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(inside & (~after | np.append(cut[1:], False))) + 1
        kinds, first, back = np.unique(hash_spans(flat, starts, ends), return_index=True, return_inverse=True)
        if len(known) > remember:
            known.clear()
        new = known.missing(kinds)
        if len(new):
            a, b = (starts[first[new]] + low).tolist(), (ends[first[new]] + low).tolist()
            words = [joined[x:y].decode("utf-8", "surrogatepass") for x, y in zip(a, b, strict=True)]
            known.add(kinds[new], encode_words(model, ends_word, words))
        ids, done = known.ids(kinds, back)
        here = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
        places.append(n_ids + np.append(0, done)[np.searchsorted(starts, here)])
        found.append(ids)
        n_ids += len(ids)
    out = np.split(np.concatenate(found), np.concatenate(places))
    return [np.array(model.encode(t, add_special_tokens=False).ids, "<u4") if "<|" in t else x for t, x in zip(texts, out[: len(texts)], strict=True)]


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id and PIECES: each document's ids and end_id, cut every capacity tokens. A null text is empty: end_id alone."""
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for whole in parts:
            for part in slices(whole, 2_000_000):
                rows = []
                for key, ids in zip(part["_id"], encode_texts([t or "" for t in part["_text"]], path), strict=True):
                    ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                    for i in range(0, len(ids), capacity):
                        piece = ids[i : i + capacity]
                        rows.append((key, i // capacity, i, len(piece), piece.astype(np.int32) if with_ids else None, zlib.crc32(piece.tobytes())))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64") if kind in ("bigint", "int") else out["doc_id"]
                yield out
        tokenizer(path)[2].clear()  # the worker lives on

    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInPandas(work, f"doc_id {kind}, {PIECES}")


def place(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset. Pieces that share all of these are placed each."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, first_bin, used = [], 0, {}
    for bin_, times in patterns(counts, capacity):
        at = 0
        for length, each in sorted(bin_.items(), reverse=True):
            low = used.get(length, 0)
            runs.append((length, low, low + each * times, each, at, first_bin))
            used[length] = low + each * times
            at += each * length
        first_bin += times
    schema = "length int, array array<struct<low:long,high:long,each:int,at:int,first:long>>"
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    slots = spark.createDataFrame(list(by_length.items()), schema)
    chunks = sorted_chunks(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "piece"], "pack-pieces")
    numbered = running_sums(chunks, "length", "_one", "_rank").drop("_one")
    # Broadcast: every pattern uses a length up or follows one that did, so there are about as many runs as lengths.
    joined = numbered.join(F.broadcast(slots), "length")
    run = F.element_at(F.filter("array", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"])), 1)
    placed = joined.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.low"))
    return placed.withColumns(
        {
            "sequence_id": F.expr("_run.first + (_k div _run.each)"),
            "offset": (F.col("_run.at") + (F.col("_k") % F.col("_run.each")) * F.col("length")).cast("long"),
        }
    ).drop("array", "_run", "_k", "_rank")


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, with_ids: bool = True, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    Null and empty texts give a piece of the end id alone. Repeated rows are packed each; an empty table gives an empty
    one; other columns of docs are ignored.
    """
    pieces = token_pieces(docs, path, capacity=capacity, with_ids=with_ids, **options)
    if not with_ids:
        return place(stage(pieces, "pack-tokens"), capacity=capacity)
    # Lengths are numbered and placed without the ids, which move once, to their places.
    pieces = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    placed = place(pieces.drop("ids"), capacity=capacity)
    return placed.join(pieces.select("_row", "ids"), "_row").drop("_row")
