"""The prefix trie against a plain one, for several band heights."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from strataforge.llm import trie


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, cs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(cs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, top int")
    return sorted(map(tuple, trie.prefix_trie(df.repartition(3), **options).collect()), key=lambda r: r[:2])


ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "é漢😀"), (0, None, None, None),
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "no"),
    (2, 5, "a", "bc"), (3, 5, "ab", "c"), (4, None, "", ""), (5, 1, None, "x"), (6, 1, "", "x"),
    (107, 0, "user", "lonely"), (205, 0, "u", "a"), (206, 0, "u", "a"), (200, 0, "u", "a"), (-7, 0, "u", "m"), (None, 0, "u", "no conversation"),
]


@pytest.mark.parametrize("height", [2, 32])
def test_odd_rows(spark, height):
    got = found(spark, ODD, height=height)
    assert got == brute(ODD)
    assert any(r[3] and r[1] == 0 for r in got)


def test_empty(spark):
    assert found(spark, ODD[:1])[0][1] == 0
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0


def test_long_paths_and_copies(spark):
    """One conversation of 150 turns beside many copies, in bands of four: three levels of bands."""
    rows = [(1000, t, "u", f"t{t}" * (t % 3)) for t in range(150)]
    rows += [(1001, t, "u", f"t{t}" * (t % 3)) for t in range(120)] + [(1002, t, "u", f"t{t}" * (t % 3) if t != 70 else "fork") for t in range(140)]
    rows += [(c, t, "u", "copy") for c in range(2000, 2090) for t in range(4)]
    assert found(spark, rows, height=4) == brute(rows)


def test_ends_across_chunks(spark):
    """The ids that end at one node lie in several chunks; their digest is that of the whole list."""
    ends = spark.range(5000).selectExpr("cast(id % 2 * 9 as long) as top", "cast(3 as long) as depth", "id as conv").repartition(5)
    got = {r.top: r.sha for r in trie.hashed_ends(ends).collect()}
    assert got == {9 * k: hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest() for k in (0, 1)}


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, trie.prefix_trie(df, height=3).collect()), key=lambda r: r[:2]) == brute(rows)
