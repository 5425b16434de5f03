"""Near-duplicates and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strataforge.llm import common, neardup, shingles
from strataforge.llm.components import components, merged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def roots(nodes, edges):
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    where = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(k)
    edges = set()
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for other in where[x]:
                if other < k:
                    shared[other] += 1
        edges |= {(i, sets[o][0]) for o, c in shared.items() if 100 * c >= percent * (len(s) + len(sets[o][1]) - c)}
    return {i: len(s) for i, s in sets}, roots([i for i, _ in rows], edges)


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, documents, n, percent):
    rng = random.Random(n)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    at = 10_000
    for _ in range(12):
        base = " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.choice([3, 7, 12, 40, 200])))
        for text in family(rng, base, rng.choice([2, 5, 40]), 4):
            rows.append((at, text))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2L as rep", "text as regs")
    sizes, want = brute(rows, n, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=n, percent=percent).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_borderline_family(spark):
    """Copies that don't all link with the first: links beside the hub must be found too."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(100), 3):
            words[k] = f"w{rng.randrange(10**6)}" if rng.random() < 0.7 else f"u{k}"
        rows.append((i, " ".join(words)))
    _, want = brute(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < 150


def test_odd(odd, empty):
    rows = neardup.near_duplicates(odd, words=3, percent=85).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[2].component_id, by[2].kept, by[1].kept) == (1, False, True)
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (3, 4, 7))
    assert by[6].component_id == 6 and by[6].n_shingles == 1
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_first(odd).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 4, 5, 6, 7, 8, 9] and kept[0].asDict().keys() == odd.first().asDict().keys()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in roots(range(1000), edges).items() if k in linked}
    first, rest = (spark.createDataFrame(e, "a long, b long") for e in (edges[:150], edges[150:]))
    assert {r.id: r.component for r in merged(components(first), rest).collect()} == got


def test_shingles_agree_with_sets():
    texts = ["A b c d a B C", "", None, "x", "x y", "é Ü b c \t d\n", "a b c " * 50]
    for text, s in zip(texts, shingles.shingle_sets(texts, 3), strict=True):
        assert len(s) == len(shingle_set(text, 3)) and (np.diff(s.astype(object)) > 0).all()
    a, b = shingles.shingle_sets(["The Quick brown fox", "zz the quick BROWN fox"], 3)
    assert len(np.intersect1d(a, b)) == 2


def test_estimate_is_near():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    a, b = np.sort(x[:3600]), np.sort(x[400:])
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert abs((ra == rb).mean() - 3200 / 4000) < 0.12
    assert neardup.collision(np.array([4000]), np.array([4000]))[0] < 1e-3


def test_repeated_ids_and_no_ids(spark):
    """Any text of an id may link it; texts without an id carry links on."""
    text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b = text("a", 60), text("b", 60)
    far = [*(f"b{i}" for i in range(4, 60)), "z0", "z1", "z2"]
    rows = [(5, text("long", 400)), (5, a), (2, a + " more"), (None, b), (7, b + " q r s t"), (8, " ".join(far)), (1, ""), (1, text("c", 20)), (9, text("c", 20)), (None, text("d", 9))]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()]
    assert {c for i, c, _ in got if i in (2, 5)} == {2} and {c for i, c, _ in got if i == 9} == {1}
    assert sorted(c or 0 for i, c, _ in got if i is None) == [0, 7] and (8, 7, False) in got and (7, 7, True) in got
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in [rows[2], rows[4], rows[6], rows[7], rows[9]])


def test_rows_follow_documents(spark, monkeypatch):
    """A large family just below the threshold makes rows in proportion to its size."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(200)]
    made = []
    real = neardup.stage

    def counted(df, name):
        out = real(df, name)
        assert out._staged_path
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    most = []
    for size in (250, 1000):
        rows = []
        for i in range(size):
            words = list(base)
            for k in rng.sample(range(200), 5):
                words[k] = f"w{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        made.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()
        if size == 250:
            assert {r.doc_id: r.component_id for r in got} == brute(rows, 5, 80)[1]
        most.append(max(made))
    assert most[1] <= 33 * 1000 and most[1] <= 5 * most[0]


def test_blocks_of_small_size(spark, monkeypatch):
    """Families and buckets dealt over many blocks give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    test_borderline_family(spark)


def test_whole_groups():
    import pandas as pd

    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 12, 200))
    whole = pd.DataFrame({"a": key, "b": key * 2, "x": np.arange(200)})
    for size in (1, 3, 17, 200):
        parts = list(common.whole_groups(iter([whole.iloc[i : i + size] for i in range(0, 200, size)]), ["a", "b"]))
        assert (pd.concat(parts)["x"].to_numpy() == whole["x"].to_numpy()).all()
        assert len({k for p in parts for k in p["a"].unique()}) == sum(p["a"].nunique() for p in parts)
    assert list(common.whole_groups(iter([whole.iloc[:0]]), ["a", "b"])) == []
