"""Runs, components, prefixes and stages against plain loops."""

import random

import pytest

from strataforge.functions import tiles
from strataforge.operators import matching, spans


def test_painted(spark):
    rng = random.Random(3)
    runs = [(rng.choice("ab"), rng.randrange(-30, 60), rng.randrange(-2, 40), i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(runs, "k string, start long, n long, o long, v long").repartition(3)
    want = {}
    for k, start, n, o, v in runs:
        want |= {(k, x): (o, v) for x in range(start, start + n)}
    for block in (7, 1024):
        got = {}
        for r in spans.painted(df, ["k"], ["o"], ["o", "v"], block=block).collect():
            for x in range(r.start, r.start + r.n):
                assert (r.k, x) not in got
                got[r.k, x] = (r.o, r.v)
        assert got == want
    assert spans.painted(df.where("false"), ["k"], ["o"], ["v"]).count() == 0


def test_many_runs_over_one_place(spark):
    """Rows follow the places that runs end at, not pairs of runs."""
    df = spark.range(20_000).selectExpr("'r' as k", "id % 5 as start", "id % 7 + 1 as n", "id as o", "id as v")
    rows = spans.painted(df, ["k"], ["o"], ["v"]).collect()
    assert sum(r.n for r in rows) == 11 and len(rows) <= 11


def test_components_of_a_long_path(spark):
    """A path of 40,000 nodes settles in 20 rounds at most, beside a star and a pair."""
    edges = spark.range(40_000).selectExpr("id as a", "id + 1 as b").union(spark.range(50_000, 52_000).selectExpr("id as a", "50000 as b")).union(spark.createDataFrame([(90_000, 90_001), (90_002, 90_002)], "a long, b long"))
    comps, rounds = spans.components(edges)
    groups = {}
    for r in comps.collect():
        groups.setdefault(r.component, set()).add(r.id)
    assert sorted(map(len, groups.values())) == [2, 2000, 40_001] and rounds <= 20


def spiral(size):
    """Cells of a spiral path, one empty cell between its turns."""
    x, y, dx, dy, cells = 0, 0, 1, 0, {(0, 0)}
    while True:
        for _ in range(2):
            if not (0 <= x + dx < size and 0 <= y + dy < size) or (x + 2 * dx, y + 2 * dy) in cells:
                dx, dy = -dy, dx
        if (x + dx, y + dy) in cells or (x + 2 * dx, y + 2 * dy) in cells:
            return cells
        x, y = x + dx, y + dy
        cells.add((x, y))


def test_reach_along_a_spiral(spark):
    cells = spiral(60)
    assert len(cells) > 1500
    df = spark.createDataFrame([(*c, 1) for c in sorted(cells)] + [(100, 100, 1), (0, 0, 2)], "x long, y long, g int")
    got = {tuple(r) for r in spans.reach(df, spark.createDataFrame([(0, 0, 1)], "x long, y long, g int"), ["g"], block=3).select("x", "y", "g").collect()}
    assert got == {(*c, 1) for c in cells}


@pytest.mark.parametrize("block", [3, 64])
def test_tied_runs(spark, block):
    rng = random.Random(5)
    cells = {(g, y, x) for g in (1, 2) for y in range(25) for x in range(-10, 30) if rng.random() < 0.42}
    runs = []
    for g, y, x in sorted(cells):
        if runs and runs[-1][:2] == [g, y] and runs[-1][2] + runs[-1][3] == x and runs[-1][3] < 4:  # some runs touch
            runs[-1][3] += 1
        else:
            runs.append([g, y, x, 1])
    reached = todo = [c for c in cells if c[1] == 0]
    reached = set(reached)
    while todo:
        g, y, x = todo.pop()
        new = {(g, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & cells - reached
        reached |= new
        todo += new
    df = spark.createDataFrame([tuple(r) for r in runs], "g long, y int, x int, n int")
    got = {(r.g, r.y, x) for r in spans.tied_runs(df, ["g"], df["y"] == 0, block).collect() for x in range(r.x, r.x + r.n)}
    assert got == reached and len(got) < len(cells)


def test_first_prefix(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(300)]
    prefixes = [(w[: rng.randrange(1, 5)], rng.randrange(100)) for w in words[:60] if w] + [("", 99), ("é", 1), (None, 0), ("a", 50), ("a", 40)]
    names = [(i, w) for i, w in enumerate([*words, None, "", "été", "abé", "\U0001f600"])]
    df = spark.createDataFrame(names, "i long, name string").repartition(4)
    for known in (prefixes, [p for p in prefixes if p[0] != ""]):
        got = {r.i: (r.ord, r.prefix) for r in matching.first_prefix(df, "name", spark.createDataFrame(known, "prefix string, ord long")).collect()}
        best = lambda w: min(((o, p) for p, o in known if p is not None and w is not None and w.startswith(p)), default=(None, None))  # noqa: B023, E731
        assert got == {i: best(w) for i, w in names}
    plan = matching.first_prefix(df, "name", spark.createDataFrame(prefixes, "prefix string, ord long"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stages(spark):
    markers = [("Extracting", 4, "a"), ("screens", 52, "b"), ("Auditing", 78, "c")]
    lines = ["x", "Extracting screens", "loading screens", "Extracting", None, "Auditing", "screens", ""]
    df = spark.createDataFrame([(k, i, line) for k in (1, 2) for i, line in enumerate(lines[k - 1 :])], "k int, i int, line string").repartition(3)
    got = {(r.k, r.i): (r.progress, r.stage) for r in matching.stages(df, "line", ["k"], ["i"], markers).collect()}
    assert [got[1, i] for i in range(8)] == [(0, None), (4, "a"), (52, "b"), (52, "b"), (52, "b"), (78, "c"), (78, "c"), (78, "c")]
    assert got[2, 0] == (4, "a") and len(got) == 15
    with pytest.raises(ValueError):
        matching.stages(df, "line", ["k"], ["i"], [("a", 1, "x"), ("b", 1, "y")])


def test_spans_of_tiles():
    import numpy as np

    of, found = tiles.spans_of([b"", b"junk", b"\x03\x00" + bytes(40), b"\x01\x00" + bytes(40)], [True, False, True, True])
    assert len(of) == 0 and all(len(v) == 0 for v in found.values())
    first, n = tiles.equal_runs(np.array([1, 1, 2, 2, 2, 2]), 3)
    assert first.tolist() == [0, 2, 3] and n.tolist() == [2, 1, 3]
