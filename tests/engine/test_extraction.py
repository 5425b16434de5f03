"""Synthetic archives through the whole plan."""

import builder as B
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from strataforge.functions import png
from strataforge.operators.idioms import written
from strataforge.plans import extraction as X
from strataforge.sources.archive import ENTRY_SCHEMA, MAGIC, ArchiveReader, entries, header_size, index, landed, ranged

ENTRY_SCHEMA_NAMES = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

NAMES = [(8, "Stand"), (80, "Build"), (9, "Walk"), (1000, "Interface"), (1002, "Icon")]
XML = """<r><a><Description ID="7" Name="Hero One" Description="The hero"><x><ImageIDBase value="AV01"/></x></Description></a>
<Description Name="gone"/><Description Name="second"><ImageIDBase value="AV01"/><CanUse value="Monster"/></Description></r>"""


def box(w, h, value=1):
    return B.v3([[(w, [value] * w)]] * h)


def files():
    tiles = [box(2, 2), box(20, 18), B.v3([[(3, [0, 247, 1])]]), box(100, 100), box(16, 16), b"junk", B.v1([[255, 1, 1, 255], [1, 255, 255, 1], [1, 1, 1, 1]], embedded=B.palette()), B.v1([[0, 0xF800]], wide=True), box(12, 12)]
    hero = B.record([(8, B.directional({0: (-1, -2, 3, 1, [2, 1]), 4: (1, 0, 2, 2, [0]), 5: (0, 0, 1, 1, [1])})), (9, B.directional({0: (0, 0, 1, 1, [1])})), (1000, B.scan_set([3, 1, 3, 99, 5])), (1002, B.scan_set([4, 6, 0, 8]))])
    house = B.record([(80, B.state_set(2, [1, 4, 0])), (555, B.directional({0: (0, 0, 1, 1, [1])}))])
    effect = B.record([(8, B.scan_set([7, 2, 2, 5, 1, 4, 8]))])
    main = B.archive([("IMAG", [("old", b"")]), ("IMAG", [("AV01Hero", hero), ("AB02House", house), ("ZZ99Other", hero), ("XR03Fx", effect)]), ("TILE", [(f"t{i}", t) for i, t in enumerate(tiles)]), ("SPLT", [("p", B.palette())])])
    first = B.archive([("IMAG", [("MENU", B.record([(1, B.scan_set([1]))]))]), ("TILE", [("a", b""), ("b", box(5, 5))]), ("PALT", [("p", B.palette(fill=(1, 2, 3)))])])
    second = B.archive([("IMAG", [("MENU", B.record([(1, B.scan_set([1]))])), ("NOPE", B.record([(1, B.scan_set([1]))]))]), ("TILE", [("a", b""), ("b", box(6, 6))])])
    import struct

    splash = struct.pack("<I", 1) + bytes(12) + struct.pack("<HH", 2, 1) + bytes(28) + struct.pack("<2H", 0x7C00, 0x001F)
    picture = B.archive([("PICT", [("SPLH01", splash), ("MV01", b"BIK")]), ("PICT", [("SPLH02", splash)])])
    return {"main.bin": main, "menu1.bin": first, "menu2.bin": second, "pict.bin": picture}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    for name, data in files().items():
        (folder / name).write_bytes(data)
    rows = X.labelled(entries(spark, [f"{folder}/*.bin"]), {"main": "main.bin", "first": "menu1.bin", "second": "menu2.bin", "pict": "pict.bin"})
    sources = spark.createDataFrame([("main", "main", 0), ("interface", "first", 0), ("interface", "second", 1), ("picture", "pict", 0)], "family string, source string, source_ord int")
    names = spark.createDataFrame(NAMES, "set_id long, name string")
    curated = spark.createDataFrame([("MENU", "menus/main")], "image_id string, category string")
    known = X.catalog(spark.createDataFrame([(0, "characters", "a.xml", XML.replace("second", "Ignored"))], "file_ord int, kind string, source_xml string, xml string"))
    return {"entries": rows.cache(), "sources": sources, "names": names, "curated": curated, "known": known, "folder": folder}


def run(world, **options):
    """Each set of options is extracted once."""
    done = world.setdefault("done", {})
    key = str(options)
    if key not in done:
        out = written(X.extract(world["entries"], world["sources"], world["names"], world["curated"], world["known"], **options), "extracted")
        done[key] = {r.png: r for r in out.collect()}, out
    return done[key]


def test_catalog(world):
    rows = world["known"].collect()
    assert [(r.image_id, r.category, r.name, r.unit_id) for r in rows] == [("AV01", "monsters/sprites", "Ignored", "")]


def test_ranges(spark, world):
    """The source gives the same entries by range as whole files do, and filters reach its reader."""
    path = f"{world['folder']}/main.bin"
    want = entries(spark, [path])
    columns = ["section_ord", "ext", "entry_ord", "display_name", "data_offset", "data_size", "data"]
    read = ranged(spark, [path], most_bytes=500)
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert read.rdd.getNumPartitions() > 2 and read.where("ext = 'TILE'").count() == 9
    assert read.where("ext in ('TILE', 'SPLT') and data_size > 1000").count() == want.where("ext in ('TILE', 'SPLT') and data_size > 1000").count()
    heads = ranged(spark, [path, f"{world['folder']}/pict.bin"], data=False)
    assert "data" not in heads.columns and heads.where(F.col("source") == path).count() == want.count()
    bad = world["folder"] / "bad.dat"
    bad.write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="bad magic"):
        ranged(spark, [str(bad)]).count()


def test_bytes_read(world):
    """Only headers and the bytes that were asked for are read; planning opens nothing."""
    path = f"{world['folder']}/main.bin"
    raw = open(path, "rb").read()
    head, sizes = header_size(raw), {}
    for e in index(raw):
        sizes[e.ext] = sizes.get(e.ext, 0) + e.size

    def read(most=1 << 20, data=True, *filters):
        reader = ArchiveReader([path], MAGIC, most, data)
        kept = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        assert reader.bytes_read == 0
        return [r for p in parts for r in reader.read(p)], reader.bytes_read, len(parts), kept

    tile = EqualTo(("ext",), "TILE")
    assert read()[1:3] == (head + sum(sizes.values()), 1)
    assert read(1 << 20, True, tile)[1] == head + sizes["TILE"]
    assert read(1 << 20, True, In(("ext",), ("SPLT", "TILE")))[1] == head + sizes["TILE"] + sizes["SPLT"]
    rows, size, parts, kept = read(500, False, tile, EqualTo(("data_size",), 3))
    assert (size, parts, len(rows), len(kept)) == (head, 1, 9, 1)
    rows, size, parts, _ = read(500, True, tile)
    assert (size, len(rows)) == (parts * head + sizes["TILE"], 9)
    assert read(500, True, EqualTo(("source",), "elsewhere"))[:2] == ([], 0)


def test_landed(spark, world):
    """Once landed, what follows reads no archive: a step on one section reads that section's files alone."""
    path = f"{world['folder']}/main.bin"
    once = landed(ranged(spark, [path]))
    assert once.columns == ENTRY_SCHEMA_NAMES and sorted(map(str, once.collect())) == sorted(map(str, ranged(spark, [path]).collect()))
    tiles = once.where("ext = 'TILE'")
    assert len(tiles.inputFiles()) < len(once.inputFiles()) or "PartitionFilters: [isnotnull(ext" in tiles._jdf.queryExecution().toString()
    assert "ReadSchema: struct<entry_ord:int>" in once.where("ext = 'TILE'").select("entry_ord")._jdf.queryExecution().toString()


def test_labels_of_paths_that_end_alike(spark):
    rows = spark.createDataFrame([("/a/base.bin",), ("/b/base.bin",), ("base.bin",), ("/c/other.bin",)], "source string")
    got = X.labelled(rows, {"short": "base.bin", "a": "/a/base.bin"}).collect()
    assert sorted(r.source for r in got) == ["a", "short", "short"]


def test_default_preset(world):
    rows, _ = run(world)
    assert set(rows) == {
        "monsters/sprites/AV01_Ignored/Stand_dir0_frame000_tile00002.png", "monsters/sprites/AV01_Ignored/Stand_dir4_frame000_tile00000.png", "monsters/sprites/AV01_Ignored/Stand_dir5_frame000_tile00001.png",
        "profile_art/monsters/AV01_Ignored/Interface_variant00_tile00003.png",
        "icons/monsters/AV01_Ignored/Icon_variant00_tile00004.png", "icons/monsters/AV01_Ignored/Icon_variant01_tile00008.png",
        "buildings/sprites/AB02_House/Build_variant00_tile00001.png", "buildings/sprites/AB02_House/Build_variant01_tile00004.png",
        "spell_effects/XR03_Fx/Stand_variant00_tile00007.png", "spell_effects/XR03_Fx/Stand_variant01_tile00002.png", "spell_effects/XR03_Fx/Stand_variant02_tile00001.png", "spell_effects/XR03_Fx/Stand_variant03_tile00004.png",
        "menus/main/MENU/set-1_variant00_tile00001_first.png", "menus/main/MENU/set-1_variant00_tile00001_second.png",
        "loading_screens/pict_SPLH01/sample00_frame00000.png",
    }
    second = png.decode(rows["menus/main/MENU/set-1_variant00_tile00001_second.png"].image)
    assert second.shape == (6, 6, 4) and second[0, 0].tolist() == [1, 2, 3, 255]  # the palette of the source before
    hero = rows["monsters/sprites/AV01_Ignored/Stand_dir0_frame000_tile00002.png"]
    assert (hero.display_name, hero.direction, hero.w, hero.visible) == ("Ignored", 0, 3, 3)


def test_all_raw_and_art(world):
    full, _ = run(world, mode="all-raw")
    assert "monsters/sprites/AV01_Ignored/Stand_dir0_frame001_tile00001.png" in full and "other/main/ZZ99_Other/Stand_dir0_frame001_tile00001.png" in full
    assert "other/interface/NOPE/set-1_variant00_tile00001.png" in full and sum("spell_effects" in p for p in full) == 5
    assert "other/main/AB02_House/set-555_dir0_frame000_tile00001.png" in full
    art, _ = run(world, mode="relevant-art")
    assert art["monsters/sprites/AV01_Ignored/Stand_dir0_frame000_tile00002.png"].visible == 2
    with pytest.raises(ValueError):
        run(world, mode="nothing")


def test_limit(world):
    rows, _ = run(world, limit=2)
    assert {r.record for r in rows.values()} == {"AV01Hero", "AB02House"}
    with pytest.raises(ValueError):
        run(world, limit=0)


@pytest.mark.parametrize("mode", ["all-raw", "relevant-art"])
def test_audit(spark, world, mode):
    _, out = run(world, mode=mode)
    audited = X.audit(out, world["entries"], world["sources"])
    assert X.require_clean(audited) == out.where("tile_index is not null").count()
    if mode == "relevant-art":
        empty = bytearray(png.encode(np.zeros((2, 2, 4), np.uint8)))
        broken = out.withColumn("image", F.when(F.col("png").contains("dir4"), F.lit(bytes(empty))).otherwise(F.col("image")))
        with pytest.raises(RuntimeError, match="dir4.*mismatch, expected 4, found 0"):
            X.require_clean(X.audit(broken, world["entries"], world["sources"]))


def test_previews_and_manifest(spark, world, tmp_path):
    _, out = run(world)
    sheets = {r.record: png.decode(r.image).shape for r in X.previews(out).collect()}
    assert sheets == {"AV01Hero": (160, 576, 4), "AB02House": (160, 384, 4), "XR03Fx": (160, 768, 4)}
    X.write_one_manifest(out, str(tmp_path / "m.csv"))
    X.write_manifest(out, str(tmp_path / "parts"))
    parts = [line for f in sorted((tmp_path / "parts").glob("part*")) for line in f.read_bytes().decode().split("\r\n")[1:] if line]
    lines = [line for line in (tmp_path / "m.csv").read_bytes().decode().split("\r\n") if line]
    assert lines[0] == ",".join(X.MANIFEST) and len(lines) == 16 and lines[1].startswith("monsters/sprites,main,AV01,AV01Hero,Ignored,Stand,0,0,2,")
    assert parts == lines[1:]
    X.write_images(out, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 15


def test_preview_families(spark):
    rows = [("other/main", "r", s, [0, 0, 0, i, 0, 0], f"{s}{i}", i) for i, s in enumerate(["Walk-to-Stand", "Stand-to-Walk", "Die", "Stand", "Zap"])]
    rows += [("other/main", "q", "Zap", [0, 0, 1, i, 0, 0], f"z{i}", i) for i in range(12)]
    df = spark.createDataFrame(rows, "category string, record string, set string, row_ord array<int>, png string, score int").selectExpr("*", "1 as w", "1 as h", "0 as frame", "cast(null as int) as direction")
    got = {}
    for r in X.preview_rows(df).orderBy("record", "rank").collect():
        got.setdefault(r.record, []).append(r.png)
    assert got["r"] == ["Stand3", "Stand-to-Walk1"] and got["q"] == [f"z{i}" for i in range(11, 3, -1)]


def test_sheet(world):
    import json

    row = X.sprite_sheets(world["entries"], world["sources"], world["names"], prefix="av01", set_name="stand").collect()[0]
    meta = json.loads(row.meta)
    assert (meta["cols"], meta["rows"], meta["anchor_x"], meta["anchor_y"], meta["cell_w"], meta["cell_h"]) == (2, 3, 1, 2, 21, 20)
    assert png.decode(row.image).shape == (60, 42, 4) and len(meta["frames"]) == 4


def test_size_estimate(spark):
    files = spark.createDataFrame([("main", 100), ("interface", 100), ("picture", 1000)], "family string, length long")
    get = lambda mode, video: X.size_estimate(files, mode=mode, video=video).first()[0]
    assert [get("all-raw", False), get("relevant-raw", True), get("relevant-art", True)] == [650, 1360, 890]


def test_limit_stops_decoding(world, monkeypatch):
    """Records are decoded in ranges until enough give an image; the rows are those of a whole run's first records."""
    asked = []
    whole = X.decode

    def watched(refs, *args, **options):
        asked.append(refs.select("source", "record_ord").distinct().count())
        return whole(refs, *args, **options)

    rows, _ = run(world)
    keys = sorted({tuple(r.row_ord[:3]) for r in rows.values()})
    monkeypatch.setattr(X, "decode", watched)
    few = {r.png: r for r in X.extract(world["entries"], world["sources"], world["names"], world["curated"], world["known"], limit=1, first_range=1).collect()}
    seen, asked[:] = sum(asked), []
    assert set(few) == {p for p, r in rows.items() if tuple(r.row_ord[:3]) == keys[0]}
    assert few[min(few)].image == rows[min(few)].image
    more = X.extract(world["entries"], world["sources"], world["names"], world["curated"], world["known"], limit=3, first_range=1)
    assert {tuple(r.row_ord[:3]) for r in more.collect()} == set(keys[:3]) and sum(asked) > seen
    with pytest.raises(ValueError):
        X.extract(world["entries"], world["sources"], world["names"], world["curated"], world["known"], limit=0)


def test_spans_agree_with_the_renderer():
    """Runs of tiles, the last on top, are their stored pixels."""
    overlapping = B.v3([[(5, [1, 1, 2, 3, 3]), (4, [7, 7]), (9, [1])], [(0, [])]], width=9)
    dense, narrow = B.v1([[0, 0xF800], [5, 5]], wide=True), B.v3([[(2, [0x7C00, 0x001F])]], size=2)
    of, found = X.tiles.spans_of([overlapping, b"junk", dense, narrow], [True, True, True, False])
    rows = [dict(zip(found, values)) | {"tile": int(i)} for i, *values in zip(of.tolist(), *(v.tolist() for v in found.values()))]
    grid = {}
    for r in sorted((r for r in rows if r["tile"] == 0), key=lambda r: r["ord"]):
        assert (r["version"], r["size"], r["clear"], r["w"], r["h"]) == (3, 1, -1, 9, 2)
        grid |= {(r["y"], r["x"] + i): r["value"] for i in range(r["n"])}
    assert grid == {(0, 0): 1, (0, 1): 1, (0, 2): 7, (0, 3): 7, (0, 4): 3, (0, 8): 1}
    assert [(r["y"], r["x"], r["n"], r["value"], r["size"], r["clear"]) for r in rows if r["tile"] == 2] == [(0, 0, 1, 0, 2, 255), (0, 1, 1, 0xF800, 2, 255), (1, 0, 2, 5, 2, 255)]
    assert [(r["x"], r["value"], r["w"]) for r in rows if r["tile"] == 3] == [(0, 0x7C00, 2), (1, 0x1F, 2)]
    assert {r["tile"] for r in rows} == {0, 2, 3}


def test_groups_over_many_batches(spark):
    """Groups that lie in several batches stay whole, null keys count as equal, and rows come in order."""
    rows = [(None if i % 7 == 0 else f"g{i % 3}", i % 2, 100 - i, bytes([i])) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, h int, n int, b binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = X.in_groups(df, ["g", "h"], ["n"], lambda g, h, n, b: (g[0], h[0], len(n), ",".join(map(str, n)), b"".join(b)), "g string, h int, n long, t string, b binary").collect()
        none = X.in_groups(df.where("false"), ["g"], ["n"], lambda g, h, n, b: (g[0],), "g string").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for g, h, n, b in sorted(rows, key=lambda r: r[2]):
        want.setdefault((g, h), []).append((n, b))
    assert {(r.g, r.h): (r.n, r.t, bytes(r.b)) for r in got} == {k: (len(v), ",".join(str(n) for n, _ in v), b"".join(b for _, b in v)) for k, v in want.items()}
    assert len(got) == len(want) and none == 0
