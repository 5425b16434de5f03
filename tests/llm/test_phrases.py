"""Misra-Gries mining against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * b < 80 * a for b in longer):
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("chunk", [60, 5000, 8_000_000])
def test_phrases(spark, chunk):
    rng = np.random.default_rng(5)
    words = ["The", "the", "QUICK", "brown", "fox", "é", "É", "x y", "a-b", "end"]
    texts = [("".join(f"{words[i]}{sep}" for i, sep in zip(rng.choice(10, n, p=[0.2, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05]), rng.choice([" ", "  ", "\t", ", ", ".\r\n"], n))), lang) for n, lang in zip(rng.integers(0, 60, 80), rng.choice(["en", "fr", None, "und"], 80))]
    texts += [(None, "en"), ("", "xx"), (".,;", "xx"), ("word " * 700, "fr"), *[("new york city hall. new york", "en")] * 9]
    df = spark.createDataFrame([(*t, 1, "p") for t in texts], "text string, lang string, f int, phrase string").repartition(3)
    got = phrases.collocations(df, least=6, chunk_chars=chunk, top=40)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(texts, 6, 40)


def test_odd_rows(odd, empty):
    assert phrases.collocations(empty).count() == 0
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, least=2).collect())) == brute(rows, 2)


def test_hot_lang_and_word(spark):
    """A third of all words is one word, and one phrase fills most texts: counts stay exact."""
    df = spark.range(2000).select(F.concat(F.lit("hot hot hot "), F.expr("concat('w', id % 50)"), F.lit(" tail")).alias("text"), F.lit("en").alias("lang"))
    got = {r.phrase: r.f for r in phrases.frequent_phrases(df, chunk_chars=4000).where("words = 2").collect()}
    assert got["hot hot"] == 4000 and got["hot w7"] == got["w7 tail"] == 40 and len(got) == 101


def test_survivors_lose_nothing():
    """Every key with the threshold's count survives a merge under tight capacity, however its counts are spread."""
    rng = np.random.default_rng(1)
    for room in (1, 2, 8):
        keys = np.concatenate([rng.integers(0, 1 << 40, 30_000), np.repeat(rng.integers(0, 1 << 40, 40), 30), np.repeat(7, 5000)]).astype(np.uint64)
        rng.shuffle(keys)
        blobs = [phrases.packed(*phrases.counted(k)) for k in np.array_split(keys, 60)]
        stay = phrases.survivors(blobs, len(keys), 30, room)
        all_keys, counts = phrases.counted(keys)
        assert set(all_keys[counts >= 30]) <= set(stay)
        if room == 8:
            assert (counts[np.isin(all_keys, stay)] >= 26).all()


def test_packed_round_trip():
    rng = np.random.default_rng(4)
    keys, counts = phrases.counted(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    for k, c in ((keys, counts), (keys[:1], counts[:1]), (keys[:0], counts[:0])):
        a, b = phrases.unpacked(phrases.packed(k, c))
        assert a.tolist() == k.tolist() and b.tolist() == c.tolist()


def test_ids_tell_colliding_words_apart():
    words = phrases.Words(["aa bb aa cc", "bb"], np.array([0, 1]))
    words.hashes[:] = 5
    ids, first = words.ids()
    assert ids.tolist() == [0, 1, 0, 2, 1] and [words.word(i) for i in first] == ["aa", "bb", "cc"]
