"""Removal of repeats against a count of all windows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataforge.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        gone = gone[:-1] if len(r) else np.zeros(0, int)
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def compare(docs, length):
    rows = docs.select("doc_id", "text").collect()
    got = defaultdict(list)
    for r in repeats.remove_repeats(docs, length=length).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = defaultdict(list)
    for r, w in zip(rows, brute([r.text for r in rows], length), strict=True):
        want[r.doc_id].append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return [w for v in want.values() for w in v]


def test_documents(spark, documents):
    rng = random.Random(1)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (399, 400, 401, 430, 441, 500, 900)]
    words = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    extra = [words(rng.randrange(300)) + "".join(rng.sample(passages, rng.randint(1, 3))) + words(rng.randrange(300)) for _ in range(40)]
    extra += ["ab" * 500, "z" * 1000, "z" * 399, "z" * 401 + "y", passages[5][:450] + "Q" + passages[5][:450]]
    rows = [(i, r.text) for i, r in enumerate(documents.limit(60).collect())] + [(1000 + i, t) for i, t in enumerate(extra)]
    want = compare(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as place"), 400)
    assert any(0 < w[1] < w[0] for w in want) and any(w[2] > 1 for w in want)


@pytest.mark.parametrize("length", [120, 200])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(40, 260))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))) for i in range(120)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), length)


def test_odd(odd, empty):
    compare(odd, 400)
    assert repeats.remove_repeats(empty).count() == 0


def test_long_text_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = repeats.anchors(raw, 400)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    cut = repeats.anchors(raw, 400)
    cover = lambda a: {s: p for _, p, f, l in zip(*a, strict=True) for s in range(f, l + 1)}
    assert cover(whole) == cover(cut) and set(cover(whole)) == set(range(4601))


def test_removal_over_chunk_edges(spark, monkeypatch):
    """Bytes at a chunk's edge that occur once stay."""

    def anchors(raw, length):
        from strataforge.llm import repeats as there  # the worker's own, unpatched

        old, there.CHUNK = there.CHUNK, 700
        try:
            return there.anchors(raw, length)
        finally:
            there.CHUNK = old

    monkeypatch.setattr(repeats, "anchors", anchors)
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes().decode() for n in (5000, 3000, 6000)]
    texts += [texts[0][600:1300] + texts[1][:900]]
    want = compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400)
    assert want[2][1] == 0 and want[0][1] > 0


def brute_passages(texts, words=51):
    """Words of each text in runs of 51 words that another row holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = defaultdict(set)
    for i, w in enumerate(split):
        for at in range(len(w) - words + 1):
            holders[tuple(w[at : at + words])].add(i)
    out = []
    for w in split:
        found = [at for at in range(len(w) - words + 1) if len(holders[tuple(w[at : at + words])]) > 1]
        out.append(len({x for at in found for x in range(at, at + words)}))
    return out


def test_passages_of_words(spark, documents):
    """Passages of over 50 words in two documents are told, even those that 400 bytes leave; one document's own repeats are not."""
    rng = random.Random(7)
    words = lambda n: [rng.choice("abcdefg") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(n)]
    passages = [words(n) for n in (50, 51, 52, 58, 60, 90, 200)]
    texts = [words(rng.randrange(120)) + p + words(rng.randrange(120)) for p in passages for _ in range(3)]
    texts += [w := words(70), w, v := words(50), v, (u := words(60)) + words(9) + u + words(30) + u, passages[5][:55] + words(5) + passages[5][3:56], words(51)]
    # One text's two equal passages, which end unlike, one of them as in another text.
    texts += [(p := words(80)) + words(40) + p[:70] + words(40), words(30) + p[:75] + words(9), words(4) + p[5:60]]
    texts = [rng.choice((" ", "\n", " \t")).join(t) for t in texts] + ["ab " * 400, "ab " * 60 + "q", "q " + "ab " * 51]
    texts += [r.text for r in documents.limit(150).collect()]
    got = {r.doc_id: (r.n_passage_words, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_passages(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert want[3:6] == [51] * 3 and want[:3] == [0] * 3 and want[21:26] == [70, 70, 0, 0, 0]
    assert any(w and not got[i][1] for i, w in enumerate(want))


def test_word_units_in_chunks(monkeypatch):
    """No chunk cuts a word, even one longer than a chunk."""
    rng = random.Random(4)
    raw = " ".join("".join(rng.choice("abé") for _ in range(rng.choice((1, 5, 40, 900)))) for _ in range(300)).encode()
    cases = [raw, raw + b"\n", b" \t" + raw, b"x" * 2500, b" " * 1500, b"", raw[:701]]
    whole = [repeats.word_units(c).tolist() for c in cases]
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert [repeats.word_units(c).tolist() for c in cases] == whole
    assert [len(x) for x in whole] == [len(c.split()) for c in cases]
