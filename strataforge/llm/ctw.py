"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; a decision's context is the bits of the byte so far and the last 0 to 4 bytes. Every
node keeps Krichevsky-Trofimov counts, and a node's weighted probability mixes its own estimate with the product of its
children's, half and half, at all depths. Counts of byte strings (a byte and the four before it) are summed by Spark over
all training texts; nodes are weighted where the contexts that share their last two bytes meet, and there, too, every
string that any text holds gets its log probability, once. No node is dropped: the commonest strings are broadcast with
their log probabilities up to a stated bound, all others are joined to the texts that hold them.

Beside it stands a smoothed unigram score over words, served in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, partitions, slices, stage, whole_groups
from .shingles import mix, words

DEPTH, END = 4, 0xFF
#: Words broadcast with their counts (16 MB), and strings with their log probabilities (40 MB); all others are joined.
COMMON_WORDS, COMMON_STRINGS = 1 << 20, 1 << 21
#: Joined parts of a score are summed as whole multiples of this, so that their order does not matter.
UNIT = 2.0**-32
U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - back


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov's log probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, and the end, of each text: last byte, the three before it, then the byte itself; and each text's number of them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad, stop = bytes(DEPTH), bytes([END])
    flat = np.frombuffer(b"".join(x for r in raw for x in (pad, r, stop)), np.uint8).astype(U)
    n = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(n + DEPTH)
    real = np.ones(len(flat), bool)
    for i in range(DEPTH):
        real[ends - n - DEPTH + i] = False
    at = np.flatnonzero(real)
    key = flat[at - 1] << U(32) | flat[at - 2] << U(24) | flat[at - 3] << U(16) | flat[at - 4] << U(8) | flat[at]
    return key, n


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values (one or more for each key)."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(value, first, axis=0)


def level(key: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth: context << 8 | bits so far (with a leading 1), sorted; their counts of 0 and 1."""
    context, symbol = key >> U(8 * (5 - depth)) << U(8), key & U(0xFF)
    both, n = summed(context | symbol, count)
    context, symbol = both >> U(8) << U(8), both & U(0xFF)
    nodes = np.concatenate([context | U(1 << b) | symbol >> U(8 - b) for b in range(8)])
    ones = np.concatenate([(symbol >> U(7 - b) & U(1)).astype(np.int64) * n for b in range(8)])
    node, total = summed(nodes, np.tile(n, 8))
    return node, total - summed(nodes, ones)[1], summed(nodes, ones)[1]


def weigh(own: np.ndarray, node: np.ndarray, child: np.ndarray, child_pw: np.ndarray) -> np.ndarray:
    """log weighted probability of nodes: half their own estimate, half the product of their children's."""
    parent = child >> U(16) << U(8) | child & U(0xFF)
    product = np.bincount(np.searchsorted(node, parent), weights=child_pw, minlength=len(node))
    return np.logaddexp(own, product) - np.log(2)


class Subtree:
    """The nodes of depth 2 to 4 of one two-byte context, with their counts and log weighted probabilities."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.levels = {d: level(key, count, d) for d in range(2, DEPTH + 1)}
        self.own = {d: log_kt(n0.astype(float), n1.astype(float)) for d, (_, n0, n1) in self.levels.items()}
        self.pw = {DEPTH: self.own[DEPTH]}
        for d in range(DEPTH - 1, 1, -1):
            self.pw[d] = weigh(self.own[d], self.levels[d][0], self.levels[d + 1][0], self.pw[d + 1])

    def predictions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, nodes, the mixed prediction of a 1 where the node is the deepest that is known), from depth 2 on."""
        mixed, left = None, None
        for d, (node, n0, n1) in self.levels.items():
            estimate = (n1 + 0.5) / (n0 + n1 + 1.0)
            if d > 2:
                up = np.searchsorted(self.levels[d - 1][0], node >> U(16) << U(8) | node & U(0xFF))
                before, rest = mixed[up], left[up]
            else:
                before, rest = np.zeros(len(node)), np.ones(len(node))
            yield d, node, before + rest * estimate
            weight = np.exp(np.minimum(0, self.own[d] - np.log(2) - self.pw[d])) if d < DEPTH else np.ones(len(node))
            mixed, left = before + rest * weight * estimate, rest * (1 - weight)


class Top:
    """Depths 0 and 1, from the sums of depth 2 by last byte and bits."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, pw: np.ndarray):
        grid = lambda c: np.bincount(node, weights=c, minlength=65536).reshape(256, 256)
        n0, n1, product = grid(n0), grid(n1), grid(pw)
        own = log_kt(n0, n1)
        pw = np.logaddexp(own, product) - np.log(2)
        root0, root1 = n0.sum(axis=0), n1.sum(axis=0)
        root_own = log_kt(root0, root1)
        root_pw = np.logaddexp(root_own, pw.sum(axis=0, where=n0 + n1 > 0)) - np.log(2)
        w1, w0 = np.exp(np.minimum(0, own - np.log(2) - pw)), np.exp(np.minimum(0, root_own - np.log(2) - root_pw))
        e1, e0 = (n1 + 0.5) / (n0 + n1 + 1), (root1 + 0.5) / (root0 + root1 + 1)
        seen = n0 + n1 > 0
        self.fixed = np.where(seen, w0 * e0 + (1 - w0) * w1 * e1, e0)
        self.share = np.where(seen, (1 - w0) * (1 - w1), 0.0)
        self.short = np.where(seen, e1, 0.5)

    def log2(self, key: np.ndarray, tree: Subtree | None) -> np.ndarray:
        """log2 probability of the last byte of strings of one two-byte context; tree: None where it was never seen."""
        symbol, last, out = key & U(0xFF), (key >> U(32)).astype(np.int64), np.zeros(len(key))
        known = list(tree.predictions()) if tree else []
        for b in range(8):
            bits = U(1 << b) | symbol >> U(8 - b)
            deep = self.short[last, bits.astype(np.int64)]
            for d, node, p in known:
                want = key >> U(8 * (5 - d)) << U(8) | bits
                at = np.minimum(np.searchsorted(node, want), len(node) - 1)
                deep = np.where(node[at] == want, p[at], deep)
            p1 = self.fixed[last, bits.astype(np.int64)] + self.share[last, bits.astype(np.int64)] * deep
            out += np.log2(np.where(symbol >> U(7 - b) & U(1) == 1, p1, 1 - p1))
        return out


def count_strings(docs: DataFrame) -> DataFrame:
    """kind (0: byte strings, 1: words), key, n in training texts, m in all: partial counts of each task; Spark sums them."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merge(kind: int) -> None:
            kept[kind] = [summed(np.concatenate([k for k, _ in kept[kind]]), np.concatenate([n for _, n in kept[kind]]))]

        def rows(kind: int) -> pd.DataFrame:
            merge(kind)
            key, n = kept[kind].pop()
            return pd.DataFrame({"kind": kind, "key": key.view(np.int64), "n": n[:, 0], "m": n[:, 1]})

        for whole in parts:
            for part in slices(whole):
                texts, trains = part["_text"].tolist(), part["_train"].to_numpy(bool)
                key, n = grams(texts)
                word, _, owner = words(texts)
                for kind, (key, train) in enumerate(((key, np.repeat(trains, n)), (word, trains[owner]))):
                    kept[kind].append(summed(key, np.stack([train, np.ones(len(key), bool)], axis=1).astype(np.int64)))
                    if sum(len(k) for k, _ in kept[kind]) > 2_000_000:
                        merge(kind)
                        if len(kept[kind][0][0]) > 1_000_000:
                            yield rows(kind)
        for kind in (0, 1):
            if kept[kind]:
                yield rows(kind)

    return docs.mapInPandas(work, "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def by_context(strings: DataFrame, work, schema: str) -> DataFrame:
    """work(key, n, m) for the strings of each two-byte context, keys sorted; 256 ** 3 of them at most."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(parts, ["c"]):
            key, n, m, c = part["key"].to_numpy().view(U), part["n"].to_numpy(), part["m"].to_numpy(), part["c"].to_numpy()
            edges = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist()
            for a, b in zip(edges, [*edges[1:], len(c)], strict=True):
                yield work(key[a:b], n[a:b], m[a:b])

    dealt = strings.withColumn("c", F.shiftrightunsigned("key", 24)).repartition(partitions(strings.sparkSession), "c").sortWithinPartitions("key")
    return dealt.mapInPandas(run, schema)


def code_lengths(strings: DataFrame) -> DataFrame:
    """(key, m, v): the log2 probability of each string's last byte after its context, from all nodes."""

    def tops(key: np.ndarray, n: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        tree = Subtree(key[n > 0], n[n > 0])
        node, n0, n1 = tree.levels[2]
        return pd.DataFrame({"node": (node >> U(8) & U(0xFF00) | node & U(0xFF)).astype(np.int64), "n0": n0, "n1": n1, "pw": tree.pw[2]})

    sums = by_context(strings.where("n > 0"), tops, "node long, n0 long, n1 long, pw double")
    sums = sums.groupBy("node").agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"), F.sum(F.col("pw").cast("decimal(28,6)")).cast("double").alias("pw"))
    top = Top(*arrays(stage(sums, "ctw-top").select("node", "n0", "n1", "pw")))  # 65,536 rows at most

    def lengths(key: np.ndarray, n: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        seen = n > 0
        return pd.DataFrame({"key": key.view(np.int64), "m": m, "v": top.log2(key, Subtree(key[seen], n[seen]) if seen.any() else None)})

    return by_context(strings, lengths, "key long, m long, v double")


class Lookup:
    """Values of sorted keys: by a table of slots, in which the commonest key of a slot stands, else by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, often: np.ndarray):
        """often: places of the keys, the commonest last."""
        self.keys, self.values = np.append(keys, U(0xFFFFFFFFFFFFFFFF)), np.append(values, 0.0)
        self.mask = U((1 << max(8, int(2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, len(keys), np.int32)
        self.slots[(mix(keys[often]) & self.mask).astype(np.int64)] = often

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of those keys that are not there (value 0)."""
        at = self.slots[(mix(key) & self.mask).astype(np.int64)]
        other = np.flatnonzero(self.keys[at] != key)
        out = self.values[at]
        new, back = np.unique(key[other], return_inverse=True)
        place = np.searchsorted(self.keys, new)
        there = self.keys[place] == new
        out[other] = np.where(there, self.values[place], 0.0)[back]
        return out, other[~there[back]]


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of bounded size, on the driver, brought over as packed bytes instead of rows."""
    kinds = {c: np.int64 if kind == "bigint" else np.float64 for c, kind in df.dtypes}

    def pack_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({c: [part[c].to_numpy(kind).tobytes()] for c, kind in kinds.items()})

    rows = list(df.mapInPandas(pack_rows, ", ".join(f"{c} binary" for c in kinds)).toLocalIterator())
    return [np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[c], kind) for r in rows]]) for c, kind in kinds.items()]


def often(counts: DataFrame, n: str, most: int) -> int:
    """The least bin (of sixteenths of log2) of column n such that the rows from it on are `most` at most."""
    sizes = counts.groupBy(bin_of(n).alias("bin")).count().orderBy(F.desc("bin")).collect()  # 1,024 bins at most
    total, least = 0, 1 << 20
    for r in sizes:
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["bin"]
    return least


def bin_of(n: str) -> Column:
    return F.floor(F.log2(F.col(n)) * 16).cast("int")


def looked_up(counts: DataFrame, value: str) -> Lookup:
    key, m, v = arrays(counts.select("key", "m", F.col(value).cast("double").alias("v")))
    order = np.argsort(key.view(U))
    key, m, v = key.view(U)[order], m[order], v[order]
    return Lookup(key, v, np.argsort(m, kind="stable"))


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose fold is not `held` train both models; every row is scored. Null and empty texts are the end alone: one
    token, one byte sign. Null ids train. Rows are scored each for itself, so repeated rows get equal values. An empty
    table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), (fold(docs[id_col], modulus) == held).alias("held_out"))
    counts = stage(count_strings(rows.select("_text", (~F.col("held_out")).alias("_train"))), "lm-counts")
    n_train = rows.where("not held_out").count()
    seen = counts.where("kind = 1 and n > 0")
    kinds, tokens = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, kinds = tokens + n_train, kinds + (n_train > 0)
    space = float(tokens + kinds + 1)
    strings = stage(code_lengths(counts.where("kind = 0").drop("kind")), "ctw-strings").withColumns({"kind": F.lit(0), "v": F.col("v") * float(np.log10(2))})
    # A word without training counts has the same part in any text, so the broadcast and the join leave it out.
    vocabulary = seen.select("key", "m", F.log10((F.col("n") + 1) / F.lit(space)).alias("v"), F.lit(1).alias("kind"))
    unseen = float(np.log10(1 / space))
    least = [often(strings, "m", COMMON_STRINGS), often(vocabulary, "m", COMMON_WORDS)]
    shared = spark.sparkContext.broadcast([looked_up(x.where(bin_of("m") >= b), "v") for x, b in zip((strings, vocabulary), least, strict=True)])
    end = float(np.log10((n_train + 1) / space))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, known = shared.value
        for whole in parts:
            for part in slices(whole):
                texts = part["_text"].tolist()
                key, n = grams(texts)
                value, far = code.find(key)
                score = np.add.reduceat(value, np.append(0, np.cumsum(n)[:-1]))
                word, _, owner = words(texts)
                value, new = known.find(word)
                base = np.bincount(owner, weights=value, minlength=len(part)) + end
                per_text = np.bincount(owner, minlength=len(part))
                own = {c: part[c].to_numpy() for c in ("row", "held_out")} | {"doc_id": part["doc_id"].values}
                counts = {"n_tokens": per_text + 1, "n_known": per_text - np.bincount(owner[new], minlength=len(part)) + (n_train > 0)}
                yield pd.DataFrame(own | counts | {"base": base, "score": score, "n_bytes": n, "kind": -1, "key": 0, "m": 0})
                for kind, of, k in ((0, np.repeat(np.arange(len(part)), n)[far], key[far]), (1, owner[new], word[new])):
                    if len(of):
                        pairs, m = np.unique(np.rec.fromarrays([of, k], names="o,k"), return_counts=True)
                        yield pd.DataFrame({"row": own["row"][pairs["o"]], "doc_id": None, "held_out": False, "n_tokens": 0, "n_known": 0, "base": 0.0, "score": 0.0, "n_bytes": 0, "kind": kind, "key": pairs["k"].copy().view(np.int64), "m": m})

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, kind int, key long, m long"
    out = stage(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(work, schema), "lm-rows")
    rare = strings.where(bin_of("m") < least[0]).select("kind", "key", "v").union(vocabulary.where(bin_of("m") < least[1]).select("kind", "key", "v"))
    parts = out.where("kind >= 0").select("row", "kind", "key", "m").join(rare, ["kind", "key"], "left")
    units = F.col("m") * F.round(F.coalesce("v", F.lit(unseen)) / UNIT).cast("long")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(F.lit(0)))
    more = parts.groupBy("row").agg(of(0, units).alias("code"), of(1, units).alias("rest"), of(1, F.when(F.col("v").isNotNull(), F.col("m")).otherwise(0)).alias("also"))
    both = out.where("kind < 0").drop("kind", "key", "m").join(more, "row", "left")
    score, base = (F.col(a) + F.coalesce(b, F.lit(0)) * UNIT for a, b in (("score", "code"), ("base", "rest")))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), (-score / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
