"""Registered relational queries against their SQL, and operators on edge cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strataforge.functions import scalars as S
from strataforge.operators import idioms as I
from strataforge.operators import spans
from strataforge.plans import registry, safety
from strataforge.sources import listing

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows, order):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in (r[i] for i in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert plain(df.collect(), [df.columns.index(c) for c in names]) == plain(result.fetchall(), [columns.index(c) for c in names])


def test_reach_stops_at_walls(spark):
    cells = [(x, y) for x in range(7) for y in range(7) if not (x in (1, 5) and 1 <= y <= 5 or y in (1, 5) and 1 <= x <= 5)]
    df = spark.createDataFrame(cells, "x long, y long")
    got = {tuple(r) for r in spans.reach(df, df.where("x = 0"), []).collect()}
    assert got == {c for c in cells if not (2 <= c[0] <= 4 and 2 <= c[1] <= 4)} and len(got) < len(cells)


def test_reach_over_blocks(spark):
    """A winding path over many blocks, in two groups of which one has no seed."""
    import random

    rng = random.Random(1)
    cells = {(g, x - 9, y) for g in "ab" for x in range(30) for y in range(20) if rng.random() < 0.45}
    df = spark.createDataFrame(sorted(cells), "g string, x long, y long")
    got = {tuple(r) for r in spans.reach(df, df.where("g = 'a' and x = -9"), ["g"], block=4).collect()}
    todo = [c for c in cells if c[0] == "a" and c[1] == -9]
    want = set(todo)
    while todo:
        g, x, y = todo.pop()
        new = {(g, x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & cells - want
        want |= new
        todo += new
    assert got == want and len(want) > 20


def test_even_positions_and_videos(spark):
    ask = lambda n, k: spark.range(1).select(S.even_positions(F.lit(n), k)).first()[0]
    assert (ask(101, 5), ask(1, 5), ask(0, 5), ask(3, 12)) == ([0, 25, 50, 75, 100], [0], [], [0, 1, 2])
    head = bytes(4) + b"BIKh" + bytes(4) + (101).to_bytes(4, "little") + bytes(8) + (320).to_bytes(4, "little") + (200).to_bytes(4, "little")
    row = spark.createDataFrame([(bytearray(head),), (bytearray(40),)], "h binary").select(listing.even_frames(F.col("h"), 5), listing.video_size(F.col("h"))).collect()
    assert row[0][0] == [0, 25, 50, 75, 100] and tuple(row[0][1]) == (320, 200) and row[1][0] == [] and row[1][1] is None


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.slug(F.lit(x))) for x in (' a<b>:c  d. ', "._-", "", "x\x00y")] == ["a_b_c_d", "unnamed", "unnamed", "xy"]
    assert [one(S.format_bytes(F.lit(n))) for n in (-5, 0, 1023, 1280, 1024**2, 5 * 1024**5)] == ["0.0 B", "0.0 B", "1023.0 B", "1.2 KB", "1.0 MB", "5120.0 TB"]
    assert [one(S.inside(F.lit(a), F.lit("/a/b"))) for a in ("/a/b", "/a/b/c", "/a/bc")] == [True, True, False]
    assert [one(S.cell_label(*map(F.lit, x))) for x in (("Stand", "2", "0"), ("Active", "", "1"), ("", "", ""))] == ["Stand d2 f0", "Active f1", "frame"]
    data = F.lit(b"\x01\x02\xc3\xa9")
    assert [one(S.le_uint(data, 0, 4)), one(S.le_uint(data, 2, 2)), one(S.le_uint(data, 3, 2))] == [0xA9C30201, 0xA9C3, None]
    assert [one(F.struct(*S.bgr15(F.lit(v)))) for v in (0x7C00, 0x03E0, 0x001F)] == [(255, 0, 0), (0, 255, 0), (0, 0, 255)]


def test_stop_after(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, n int")
    ask = lambda n: sorted(r.k for r in I.stop_after(df, "k", F.col("n") > 0, n).collect())
    assert ask(2) == [0, 1, 2] and ask(99) == list(range(10))
    with pytest.raises(ValueError):
        I.stop_after(df, "k", F.col("n") > 0, 0)


def test_reconcile(spark):
    a, b = (spark.createDataFrame(rows, f"k int, {c} int") for rows, c in (([(1, 1), (2, 2), (3, 3)], "want"), ([(2, 2), (3, 9), (4, 4)], "got")))
    assert {r.k: r.status for r in I.reconcile(a, b, "k", "want", "got").collect()} == {1: "missing", 2: "ok", 3: "mismatch", 4: "unexpected"}


def test_key_value_files(spark, tmp_path):
    (tmp_path / "l.vdf").write_text('"0" { "path"   "C:\\\\Games" }\n"1" { "path" "D:\\\\x" "installdir" "A B" }\n"2" { "path" "c:\\\\games\\\\" }')
    assert [r.path for r in listing.library_paths(spark, [str(tmp_path / "l.vdf")]).collect()] == ["C:\\Games", "D:\\x"]
    roots = ["E:\\first", "", "c:\\games\\", "e:\\FIRST"]
    assert [r.path for r in listing.library_paths(spark, [str(tmp_path / "l.vdf")], roots).collect()] == ["E:\\first", "c:\\games\\", "D:\\x"]
    text = spark.read.text(str(tmp_path / "l.vdf"), wholetext=True)
    assert text.select(listing.quoted_value(F.col("value"), "installdir")).first()[0] == "A B"
    assert [r.length for r in listing.file_sizes(spark, [str(tmp_path / "l.vdf")]).collect()] == [(tmp_path / "l.vdf").stat().st_size]


def test_output_guard(tmp_path, monkeypatch):
    data, out = tmp_path / "in", tmp_path / "out"
    data.mkdir()
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert safety.validate_output(str(out), [str(data)]) == out.resolve()
    for bad in ("/", str(tmp_path / "home"), str(data), str(tmp_path), str(data / "x")):
        with pytest.raises(ValueError):
            safety.validate_output(bad, [str(data)])
    out.mkdir()
    assert safety.existing(str(out)) is None
    (out / "B").mkdir()
    (out / "a").write_text("")
    assert safety.existing(str(out)) == (2, ["a", "B/"])
    with pytest.raises(ValueError, match="2 entries"):
        safety.validate_output(str(out), [str(data)])
    (out / safety.MARKER).write_text("")
    assert safety.validate_output(str(out), [str(data)]) == out.resolve()
    with pytest.raises(ValueError, match="is a file"):
        safety.validate_output(str(out / "a"), [str(data)])


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_key_holds_nearly_all_rows(spark):
    """Numbering, filling and runs over many chunks of one key, null keys and values and an empty table included."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), i, rng.choice([None, None, None, "a", "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    by = {k: sorted((t, v) for g, t, v in rows if g == k) for k in ("hot", "cold", None)}
    want_pos, want_fill, want_next, want_runs = {}, {}, {}, []
    for k, items in by.items():
        seen = None
        for i, (t, v) in enumerate(items):
            seen = v if v is not None else seen
            want_pos[t], want_fill[t] = i, seen
            want_next[t] = items[i + 1][1] or "end" if i + 1 < len(items) else "end"
            if i and items[i - 1][1] == v:
                want_runs[-1][3] += 1
            else:
                want_runs.append([k, v, i, 1])
    assert I.chunked(df, ["k"], ["t"]).where("k = 'hot'").select("_chunk").distinct().count() > 2
    assert {r.t: r.pos for r in I.positions(df, ["k"], ["t"]).collect()} == want_pos
    assert {r.t: r.o for r in I.forward_fill(df, F.col("v"), ["k"], ["t"], "o").collect()} == want_fill
    assert {r.t: r.o for r in I.next_value(df, "v", ["k"], ["t"], F.lit("end"), "o").collect()} == want_next
    assert sorted(([r.k, r.v, r.start, r.n] for r in I.run_encode(df, ["k"], ["t"], "v").collect()), key=repr) == sorted(want_runs, key=repr)
    assert sorted(r.pos for r in I.positions(df, [], [F.desc("t")]).collect()) == list(range(600))
    none = df.where("false")
    assert [f.count() for f in (I.positions(none, ["k"], ["t"]), I.run_encode(none, ["k"], ["t"], "v"), I.next_value(none, "v", ["k"], ["t"], F.lit("end"), "o"))] == [0, 0, 0]


def test_directions_of_large_part_keys(spark, duck, tmp_path):
    """Part keys beyond 500,000 lose no direction and no frame."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 499_900)
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["record_directions"]).fetchall()
    got = registry.queries()["record_directions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.tiles // r.frames for r in got) > 500_000
