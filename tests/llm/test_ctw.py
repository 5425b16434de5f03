"""Context-tree weighting against a direct recursion, and the unigram score against counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataforge.llm import ctw

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def training(texts):
    """counts[depth][context, bits] = [n0, n1]; a context is the last bytes, latest first."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(ctw.DEPTH + 1)]
    for t in texts:
        raw = bytes(ctw.DEPTH) + (t or "").encode() + b"\xff"
        for i in range(ctw.DEPTH, len(raw)):
            past, bits = raw[i - ctw.DEPTH : i][::-1], 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                for d in range(ctw.DEPTH + 1):
                    counts[d][past[:d], bits][bit] += 1
                bits = bits << 1 | bit
    return counts


def kt(n):
    return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)


def direct(counts):
    children = defaultdict(list)
    for d in range(1, ctw.DEPTH + 1):
        for c, bits in counts[d]:
            children[c[:-1], bits].append((c, bits))

    def weighted(c, bits, known={}):  # noqa: B006
        own = kt(counts[len(c)][c, bits])
        if len(c) == ctw.DEPTH:
            return own
        if (c, bits) not in known:
            known[c, bits] = np.logaddexp(own, sum(weighted(*x) for x in children[c, bits])) - math.log(2)
        return known[c, bits]

    def predict(past, bits, d=0):
        c = past[:d]
        n = counts[d][c, bits]
        own = (n[1] + 0.5) / (sum(n) + 1)
        if d == ctw.DEPTH or (past[: d + 1], bits) not in counts[d + 1]:
            return own
        w = math.exp(kt(n) - math.log(2) - weighted(c, bits))
        return w * own + (1 - w) * predict(past, bits, d + 1)

    def score(text):
        raw, total = bytes(ctw.DEPTH) + (text or "").encode() + b"\xff", 0.0
        for i in range(ctw.DEPTH, len(raw)):
            past, bits = raw[i - ctw.DEPTH : i][::-1], 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                p = predict(past, bits) if (b"", bits) in counts[0] else 0.5
                total += math.log10(p if bit else 1 - p)
                bits = bits << 1 | bit
        return total

    return score


def check(docs, limit=None, near=1e-6):
    rows = docs.select("doc_id", "text").collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    train = [r.text for r in rows if fold(r.doc_id) != 2]
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    score = direct(training(train))
    got = defaultdict(list)
    for r in ctw.language_scores(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows[:limit]:
        g = got[r.doc_id][0]
        want = tokens(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (fold(r.doc_id) == 2, len(want), sum(counts[w] > 0 for w in want), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in want), rel=1e-9)
        assert g.score == pytest.approx(score(r.text), rel=near, abs=1e-5)
    return got


def test_small_texts(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "", None, "The the THE", "zzz qqq the", "naïve 漢字 cat", "abc " * 30] * 3
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as row", "'x' as key"))


def test_documents(documents, monkeypatch):
    """With nearly all words and strings rare, so that the joins do the work; the score is the recursion's own."""
    monkeypatch.setattr(ctw, "COMMON_WORDS", 50)
    monkeypatch.setattr(ctw, "COMMON_STRINGS", 500)
    got = check(documents, 25)
    held = [r for rows in got.values() for r in rows if r.held_out]
    assert np.mean([r.bits_per_byte for r in held]) < 4


def test_odd(odd, empty):
    rows = ctw.language_scores(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    assert ctw.language_scores(empty).count() == 0
    alone = ctw.language_scores(odd.where("text is null")).collect()
    assert [r.n_tokens for r in alone] == [1]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.25, 1e3, 1e7])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_broadcast_and_join_agree(documents, monkeypatch):
    some = documents.limit(60)
    want = sorted((r.doc_id, r.score, r.base_score, r.n_known) for r in ctw.language_scores(some).collect())
    monkeypatch.setattr(ctw, "COMMON_WORDS", 0)
    monkeypatch.setattr(ctw, "COMMON_STRINGS", 0)
    got = sorted((r.doc_id, r.score, r.base_score, r.n_known) for r in ctw.language_scores(some).collect())
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_lookup():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 5000, 3000).astype(np.uint64))
    look = ctw.Lookup(keys, keys * 2.0, rng.permutation(len(keys)))
    asked = rng.integers(0, 6000, 20_000).astype(np.uint64)
    value, gone = look.find(asked)
    assert (value == np.where(np.isin(asked, keys), asked * 2.0, 0)).all() and set(gone) == set(np.flatnonzero(~np.isin(asked, keys)))
