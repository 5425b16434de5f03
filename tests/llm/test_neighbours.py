"""The forest's search against brute force."""

import numpy as np
import pytest

from strataforge.llm import neighbours

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    rows = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    out = {}
    for q, v in rows:
        if q % every == 0:
            best = {}
            for i, s in zip(ids, x @ v):
                if i != q:
                    best[int(i)] = max(best.get(int(i), -np.inf), s)
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute(vectors.select("vec_id", "embedding").collect(), 20, 20)
    got = {}
    for r in neighbours.nearest(vectors, leaf_size=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(r.vec_id): np.array(r.embedding, float) for r in vectors.collect()}
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, len(found) + 1))
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s, _ in found:
            assert s == pytest.approx(float(exact[q] @ exact[i]), abs=1e-12) and i != q


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (40, [3.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<double>, leaf string, score int")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 20, 20)
    assert neighbours.nearest(df.where("false")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "vec_id long, embedding array<float>")
    top = neighbours.nearest(same, leaf_size=16, sample=100, group_rows=64).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in top] == list(range(20)) and {r.score for r in top} == {5.0}


def test_ties_across_leaves(spark):
    """Equal vectors in different leaves and groups score equally, to the last bit, and the smaller id comes first."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 33))
    rows = [(i, base[i % 40].tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, every=40, leaf_size=16, group_rows=7, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    for q, found in got.items():
        scores = neighbours.inner(x, x[q])
        want = sorted(((i, s) for i, s in enumerate(scores.tolist()) if i != q), key=lambda p: (-p[1], p[0]))[:20]
        assert found == want
    assert len(got) == 30


@pytest.mark.parametrize("times", [2, 5])
def test_repeated_rows(spark, times):
    """Copies of rows change nothing; k ids are found however many rows they have."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    want = brute(rows, 20, 20)
    got = {}
    df = spark.createDataFrame(rows * times, "vec_id long, embedding array<double>")
    for r in neighbours.nearest(df, leaf_size=16, group_rows=64, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_one_id_on_many_rows(spark):
    """2,000 rows of one id, equal and different ones, crowd every leaf: each query still finds its 20 ids."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(7, [9.0, 1.0, 0.0, 0.0, 0.0, 0.0])] * 1000 + [(40, (rng.normal(size=6) * 3).tolist()) for _ in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, leaf_size=32, recall=0.99).collect()
    per = {}
    for r in found:
        per.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(per) == set(range(0, 300, 20)) and all(len(ids) == 20 and q not in ids for q, ids in per.items())
    want = brute(rows, 20, 20)
    assert sum(len(per[q] & {i for i, _ in want[q]}) for q in per) >= 0.9 * 20 * len(per)


def test_inner_is_one_number():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 77)), rng.normal(size=77)
    whole = neighbours.inner(x, q)
    assert all(neighbours.inner(x[i : i + n], q).tolist() == whole[i : i + n].tolist() for i, n in ((0, 1), (3, 2), (10, 17), (499, 1)))
    assert neighbours.inner(x[:0], q).shape == (0,)
