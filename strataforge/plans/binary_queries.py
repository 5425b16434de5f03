"""Queries over the star-schema tables for the binary operators: bytes are laid out from columns, then parsed or drawn.

Each query's SQL computes from the columns what the bytes must hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import png, ragged, records, tiles
from strataforge.functions import scalars as S
from strataforge.plans import rules as R


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def le(value: Column, size: int) -> Column:
    """An unsigned number as size little-endian bytes."""
    byte = lambda i: F.shiftleft(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255)), 8 * (size - 1 - i))
    return F.unhex(F.lpad(F.hex(reduce(Column.bitwiseOR, [byte(i) for i in range(size)])), 2 * size, "0"))


def zeros(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), (F.lit(n) if isinstance(n, int) else n).cast("int")))


def together(pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its lines in order: array of (l_linenumber, l_partkey, l_suppkey)."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))


def parsed(df: DataFrame, work, schema: str) -> DataFrame:
    """work(row) gives tuples of schema for each row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([x for row in part.itertuples(index=False) for x in work(row)], columns=names)

    return df.mapInPandas(run, schema)


def batched(df: DataFrame, work, schema: str) -> DataFrame:
    """work(batch of rows) gives the columns of schema, in order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(dict(zip(names, work(part), strict=True)))

    return df.mapInPandas(run, schema)


def record_sets(spark, sf_dir):
    """Sets of a record (id, start, end), one for each line of an order."""
    n = F.size("lines")
    pairs = F.transform("lines", lambda x, i: F.concat(le(x["l_partkey"], 4), le(24 + 8 * n + 10 * i, 4)))
    rows = orders_lines(spark, sf_dir).select("l_orderkey", F.concat(zeros(20), le(n, 4), together(pairs), zeros(10 * n)).alias("blob"))

    def work(part: pd.DataFrame) -> list[np.ndarray]:
        of, *found = ragged.sets(ragged.Blobs(part["blob"].tolist()))
        return [part["l_orderkey"].to_numpy()[of], *found]

    return batched(rows, work, "l_orderkey long, set_ord int, set_id long, start_at long, end_at long")


def record_directions(spark, sf_dir):
    """Directions of sets: each eight lines of an order fill the slots of a set, each with l_suppkey % 5 + 1 frames."""
    many = lambda x: x["l_suppkey"] % 5 + 1
    body = lambda x: F.concat(zeros(20), le(x["l_linenumber"], 2), le(x["l_partkey"] % 100, 2), le(F.lit(7), 2), le(F.lit(9), 2), zeros(20), together(F.transform(F.sequence(F.lit(1).cast("long"), many(x)), lambda k: F.concat(zeros(4), le(k + x["l_partkey"], 4)))))
    ends = F.aggregate("lines", F.array(F.lit(0x58).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + 0x30 + 8 * many(x))))
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.size("lines"), le(F.get("ends", i), 4)).otherwise(zeros(4)))
    per_set = orders_lines(spark, sf_dir).select("l_orderkey", "lines", F.explode(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 8").cast("int"))).alias("set_ord"))
    per_set = per_set.withColumn("lines", F.slice("lines", F.col("set_ord") * 8 + 1, F.lit(8)))
    rows = per_set.withColumn("ends", ends).select("l_orderkey", "set_ord", F.concat(zeros(0x38), together(slots), together(F.transform("lines", body))).alias("blob"), (F.array_max(F.transform("lines", lambda x: x["l_partkey"] + many(x))) + 1).alias("tiles"))

    def work(part: pd.DataFrame) -> list[np.ndarray]:
        of, slot, x, y, w, h, frame, tile = ragged.directions(ragged.Blobs(part["blob"].tolist()), np.zeros(len(part), np.int64), part["tiles"].to_numpy(np.int64))
        first = np.flatnonzero(frame == 0)
        heads = [v[first] for v in (slot, x, y, w, h)]
        keys = [part[c].to_numpy()[of[first]] for c in ("l_orderkey", "set_ord")]
        return [*keys, *heads, np.diff(np.append(first, len(of))), np.add.reduceat(tile, first) if len(first) else tile]

    return batched(rows, work, "l_orderkey long, set_ord int, slot int, x int, y int, w int, h int, frames int, tiles long")


def record_scan(spark, sf_dir):
    """Numbers of an interface set from where its tiles may begin."""
    rows = orders_lines(spark, sf_dir).select("l_orderkey", F.concat(zeros(80), together(F.transform("lines", lambda x: le(x["l_partkey"] + 70_000, 4)))).alias("blob"))

    def work(part: pd.DataFrame) -> list[np.ndarray]:
        blobs = ragged.Blobs(part["blob"].tolist())
        of, *found = ragged.scan(blobs, np.zeros(len(part), np.int64), blobs.size)
        return [part["l_orderkey"].to_numpy()[of], *found]

    return batched(rows, work, "l_orderkey long, at long, number long")


def record_walk(spark, sf_dir):
    """Tiles that a backward walk takes: the last of equal ones, those of the fitting parts, in file order."""
    pairs = together(F.transform("lines", lambda x: F.concat(zeros(4), le(x["l_partkey"], 4))))
    rows = orders_lines(spark, sf_dir).select("l_orderkey", F.concat(zeros(74), le(F.size("lines"), 2), zeros(24), pairs).alias("blob"))

    def work(part: pd.DataFrame) -> list:
        blobs = ragged.Blobs(part["blob"].tolist())
        want, of, at, tile = ragged.states(blobs, np.zeros(len(part), np.int64), blobs.size)
        edges = np.searchsorted(of, np.arange(len(part) + 1))
        pairs = [list(zip(at[a:b].tolist(), tile[a:b].tolist(), strict=True)) for a, b in zip(edges, edges[1:])]
        taken = [records.walked(n, p, {t: t % 3 != 0 for _, t in p}) for n, p in zip(want.tolist(), pairs, strict=True)]
        return [part["l_orderkey"].to_numpy(), want, [",".join(map(str, x)) for x in taken]]

    return batched(rows, work, "l_orderkey long, want int, taken string")


def tile_runs(spark, sf_dir):
    """Runs of a version-3 tile of two rows, of p_size % 7 + 1 and p_partkey % 5 + 1 pixels."""
    n = [F.col("p_size") % 7 + 1, F.col("p_partkey") % 5 + 1]
    line = lambda i: F.concat(le(n[i] + F.col("p_partkey") % 9, 2), le(n[i] + 0x8000, 2), F.unhex(F.repeat(F.lpad(F.hex(F.col("p_partkey") % 200 + i), 2, "0"), n[i].cast("int"))))
    head = F.concat(le(F.lit(3), 2), le(F.lit(2), 2), le(F.lit(20), 2), zeros(20), le(F.lit(8), 4), le(12 + n[0], 4))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(head, line(0), line(1)).alias("tile"))

    def work(part: pd.DataFrame) -> list[np.ndarray]:
        blobs = ragged.Blobs(part["tile"].tolist())
        found = ragged.tile_rows(blobs, np.ones(len(part), np.int64))
        of = found["tile"][found["row"]]
        return [part["p_partkey"].to_numpy()[of], found["w"][of], found["h"][of], np.ones_like(of), found["y"][found["row"]], found["x"], found["n"], blobs.data[found["byte"]]]

    return batched(rows, work, "p_partkey long, w int, h int, size int, y int, x int, pixels int, value int")


def tile_row_states(spark, sf_dir):
    """Bytes a pixel of tiles of one row, one tried before two, and why the row can't be read with each: sound rows and five kinds of broken ones."""
    n, kind = F.col("p_size") % 7 + 2, F.col("p_partkey") % 7
    pixels = lambda size: F.unhex(F.repeat(F.lit("07" * size), n.cast("int")))
    run = lambda x_end, word, body: F.concat(le(x_end, 2), le(word, 2), body)
    rows_of = [
        run(n + 3, n + 0x8000, pixels(1)), run(n + 3, n + 0x8000, pixels(2)), run(n + 3, n, pixels(1)), run(n - 1, n + 0x8000, pixels(1)),
        run(n + 90, n + 0x8000, pixels(1)), run(n + 3, 2 * n + 1 + 0x8000, pixels(1)), F.concat(run(n + 3, n + 0x8000, pixels(1)), zeros(1)),
    ]
    row = rows_of[-1]
    for i, r in enumerate(rows_of[:-1]):
        row = F.when(kind == i, r).otherwise(row)
    head = F.concat(le(F.lit(3), 2), le(F.lit(1), 2), le(F.lit(50), 2), zeros(20), le(F.lit(4), 4))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(head, row).alias("tile"))

    def work(part: pd.DataFrame) -> list:
        width, read = ragged.tile_widths(ragged.Blobs(part["tile"].tolist()))
        return [part["p_partkey"].to_numpy(), width, *[np.array(ragged.ROW_STATES, object)[read[size]["state"]] for size in (1, 2)]]

    return batched(rows, work, "p_partkey long, size int, as_one string, as_two string")


def tile_draw(spark, sf_dir):
    """Visible pixels and colour sums of a dense 16-bit tile, one column for each line of an order; 0 is see-through."""
    value = lambda x: (x["l_partkey"] % 4) * 9001 + F.when(x["l_partkey"] % 4 == 0, 0).otherwise(x["l_linenumber"])
    n = F.size("lines")
    head = F.concat(le(F.lit(1), 2), le(F.lit(1), 2), le(n, 2), le(2 * n, 2), zeros(18))
    rows = orders_lines(spark, sf_dir).select("l_orderkey", F.concat(head, together(F.transform("lines", lambda x: le(value(x), 2)))).alias("tile"))

    def work(r) -> list[tuple]:
        image = tiles.render(r.tile, None, crop=False).astype(np.int64)
        return [(r.l_orderkey, int((image[..., 3] > 0).sum()), *image[..., :3].sum(axis=(0, 1)).tolist())]

    return parsed(rows, work, "l_orderkey long, visible int, red long, green long, blue long")


def picture_draw(spark, sf_dir):
    """Colour sums by line of a still 15-bit picture of two lines, stored bottom line first."""
    pixel = lambda i: le((F.col("p_partkey") * 37 + i * 1031) % 32768, 2)
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(le(F.lit(1), 4), zeros(12), le(F.lit(2), 2), le(F.lit(2), 2), zeros(28), *[pixel(F.lit(i)) for i in range(4)]).alias("data"))
    return parsed(rows, lambda r: [(r.p_partkey, y, *line[:, :3].astype(np.int64).sum(axis=0).tolist()) for y, line in enumerate(tiles.picture(r.data))], "p_partkey long, y int, red long, green long, blue long")


def png_round_trip(spark, sf_dir):
    """Whole texts as the bytes of one-line images, written as PNG and read back."""

    def work(r) -> list[tuple]:
        import hashlib

        raw = (r.text or "").encode()
        raw += b" " * (-len(raw) % 4 or (0 if raw else 4))
        back = png.decode(png.encode(np.frombuffer(raw, np.uint8).reshape(1, -1, 4), level=1))
        return [(r.doc_id, back.shape[1], hashlib.md5(back.tobytes()).hexdigest())]

    return parsed(t(spark, sf_dir, "documents").select("doc_id", "text"), work, "doc_id long, width int, md5 string")


def png_chunks(spark, sf_dir):
    """Chunks of a PNG of each part, p_size % 9 + 1 by p_partkey % 5 + 1 pixels: tags, size in the header, checksums, and the pixel stream's length once inflated."""
    rows = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9 + 1).alias("w"), (F.col("p_partkey") % 5 + 1).alias("h"))

    def work(r) -> list[tuple]:
        image = np.full((r.h, r.w, 4), r.p_partkey % 256, np.uint8)
        found = list(png.chunks(png.encode(image) + b"after the end"))
        body = dict((tag, part) for tag, part, _ in found)
        w, h = struct.unpack_from(">II", body[b"IHDR"])
        stream = zlib.decompress(body[b"IDAT"])
        sound = all(zlib.crc32(tag + part) == crc for tag, part, crc in found)
        return [(r.p_partkey, b",".join(tag for tag, *_ in found).decode(), w, h, sound, len(stream), sum(stream) - sum(stream[:: 4 * w + 1]))]

    return parsed(rows, work, "p_partkey long, tags string, w int, h int, sound boolean, stream int, samples long")


def catalog_parse(spark, sf_dir):
    """Descriptions of a small XML file for each part."""
    number = F.col("p_partkey").cast("string")
    use = F.when(F.col("p_size") % 2 == 0, F.lit('<CanUse value="Monster"/><CanUse value="All"/>')).otherwise(F.lit('<CanUse value="All"/>'))
    node = F.concat(F.lit('<Data><Description ID="U'), number, F.lit('" Name="part '), number, F.lit('">'), use, F.lit('<Image><ImageIDBase value="AV'), number, F.lit('"/></Image></Description><Description ID="none"/></Data>'))
    rows = t(spark, sf_dir, "part").select(node.alias("xml"))
    return parsed(rows, lambda r: [(key, unit, name, about, ",".join(uses)) for key, unit, name, about, uses in records.catalog_rows(r.xml)], "image_id string, unit_id string, name string, description string, uses string")


def _name(prefixes: list[str], tail: str, key: str) -> Column:
    """A record's name: one of prefixes by key, then the tail."""
    return F.concat(F.element_at(F.array(*map(F.lit, prefixes)), (F.col(key) % len(prefixes) + 1).cast("int")), F.col(tail).cast("string"))


NAMES = ["AV", "BV", "AB", "BB", "XR", "WPfire", "WPrest", "XLstorm", "ZZ", "LR"]


def record_route(spark, sf_dir):
    """Where a record goes by its name, with and without the rest."""
    name = _name(NAMES, "p_size", "p_partkey")
    known = F.when(F.col("p_partkey") % 11 == 0, "icons/spells")
    return t(spark, sf_dir, "part").select("p_partkey", R.record_category(name, known, False).alias("some"), R.record_category(name, known, True).alias("every"))


def presentation_route(spark, sf_dir):
    name = _name(["qm", "MV", "Splh", "xx"], "p_size", "p_partkey")
    return t(spark, sf_dir, "part").select("p_partkey", R.presentation_category(name).alias("category"))


def set_route(spark, sf_dir):
    """Where a set's frames and an interface set's tiles go."""
    category = F.element_at(F.array(*map(F.lit, ["heroes/sprites", "buildings/sprites", "spell_effects", "monsters/sprites", "buildings/lairs"])), (F.col("l_partkey") % 5 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, [1, 8, 16, 80, 128, 192, 208, 2200, 77])), (F.col("l_suppkey") % 9 + 1).cast("int"))
    side = F.when(F.col("l_linenumber") % 3 == 0, 1000).when(F.col("l_linenumber") % 3 == 1, 1002).otherwise(5)
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    known = [80, 192, 208, 1]
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.sprite_set_category(category, base, known, False).alias("some"), R.sprite_set_category(category, base, known, True).alias("every"), R.interface_set_category(category, side).alias("interface"))


def interface_fit(spark, sf_dir):
    """Which tiles fit their category by size, and the decode flags of the category."""
    category = F.element_at(F.array(*map(F.lit, ["profile_art/heroes", "icons/spells", "menus", "heroes/sprites"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = t(spark, sf_dir, "part").select("p_partkey", category.alias("category"), (F.col("p_size") * 4).alias("w"), (F.col("p_partkey") % 150).alias("h"))
    rows = R.with_flags(rows, True)
    return rows.select("p_partkey", R.fits_interface(F.col("category"), F.col("w"), F.col("h")).alias("fits"), "preserve", "clean", "opaque", "enclosed")


def set_family(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*map(F.lit, [*R.FAMILIES, "Standing"])), (F.col("p_partkey") % 10 + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(""))
    return t(spark, sf_dir, "part").select("p_partkey", R.family(name).alias("place"))


def path_inside(spark, sf_dir):
    """Containment by path components, whatever the case."""
    path = F.concat(F.lit("/Data/"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "x").otherwise(""), F.lit("/"), F.col("p_partkey").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", S.inside(path, F.lit("/data/brand#11/")).alias("inside"))


def bgr15_scale(spark, sf_dir):
    r, g, b = S.bgr15((F.col("event_id") * 37) % 32768)
    return t(spark, sf_dir, "events").select("event_id", r.alias("r"), g.alias("g"), b.alias("b"))


_ALL = (record_sets, record_directions, record_scan, record_walk, tile_runs, tile_row_states, tile_draw, picture_draw, png_round_trip, png_chunks, catalog_parse, record_route, presentation_route, set_route, interface_fit, set_family, path_inside, bgr15_scale)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _pick(values: list, key: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][{key} % {len(values)} + 1]"


def _bits(v: str, shift: int, most: int) -> str:
    return f"((({v}) >> {shift}) & {most}) * 255 // {most}"


def _listed(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _record_rule(full: bool) -> str:
    terms = " OR ".join(f"contains(lower(name), '{x}')" for x in R.EFFECT_TERMS)
    other = " ELSE 'other/main'" if full else ""
    return f"""CASE WHEN p_partkey % 11 = 0 THEN 'icons/spells' WHEN starts_with(name, 'AV') THEN 'heroes/sprites' WHEN starts_with(name, 'BV') THEN 'monsters/sprites'
        WHEN starts_with(name, 'AB') THEN 'buildings/sprites' WHEN starts_with(name, 'BB') THEN 'buildings/lairs' WHEN name[:2] IN {_listed(R.EFFECT_PREFIXES)} THEN 'spell_effects'
        WHEN upper(name[:2]) = 'WP' OR (upper(name[:2]) = 'XL' AND ({terms})) THEN 'spell_effects'{other} END"""


def oracle_sql() -> dict[str, str]:
    lines = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
    drawn = "(l_partkey % 4) * 9001 + CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_linenumber END"
    some = "CASE WHEN NOT ((c LIKE 'buildings/%' AND b NOT IN (80, 192, 208, 1)) OR (c IN ('heroes/sprites', 'monsters/sprites') AND b NOT IN (8)) OR (c IN ('buildings/sprites', 'buildings/lairs') AND b NOT IN (80, 192, 208)) OR (c = 'spell_effects' AND b NOT IN (1, 8, 16, 128, 192, 2000, 2100, 2200))) THEN c END"
    return {
        "record_sets": f"SELECT l_orderkey, CAST(i AS INTEGER) AS set_ord, l_partkey AS set_id, 24 + 8 * n + 10 * i AS start_at, 34 + 8 * n + 10 * i AS end_at FROM {lines}",
        "record_directions": f"""SELECT l_orderkey, CAST(i // 8 AS INTEGER) AS set_ord, CAST(i % 8 AS INTEGER) AS slot, CAST(l_linenumber AS INTEGER) AS x, CAST(l_partkey % 100 AS INTEGER) AS y, 7 AS w, 9 AS h, CAST(f AS INTEGER) AS frames, CAST(f * l_partkey + f * (f + 1) // 2 AS BIGINT) AS tiles
            FROM (SELECT *, l_suppkey % 5 + 1 AS f FROM {lines})""",
        "record_scan": f"SELECT l_orderkey, 80 + 4 * i AS at, l_partkey + 70000 AS number FROM {lines}",
        "record_walk": f"""WITH l AS (SELECT l_orderkey, l_partkey, max(i) AS i, max(n) AS n FROM {lines} GROUP BY 1, 2)
            SELECT l_orderkey, CAST(max(n) AS INTEGER) AS want, coalesce(string_agg(CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END, ',' ORDER BY i), '') AS taken FROM l GROUP BY 1""",
        "tile_runs": """SELECT p_partkey, 20 AS w, 2 AS h, 1 AS size, CAST(y AS INTEGER) AS y, CAST(p_partkey % 9 AS INTEGER) AS x, CAST(CASE y WHEN 0 THEN p_size % 7 ELSE p_partkey % 5 END + 1 AS INTEGER) AS pixels, CAST(p_partkey % 200 + y AS INTEGER) AS value
            FROM part, range(2) AS r(y)""",
        "tile_row_states": """WITH a AS (SELECT p_partkey, p_partkey % 7 AS k, p_size % 7 + 2 AS n FROM part)
            SELECT p_partkey, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS size,
                CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'bytes after the end bit' WHEN 2 THEN 'no end bit' WHEN 3 THEN 'run starts before the row' WHEN 4 THEN 'run beyond the width'
                    WHEN 5 THEN CASE WHEN 2 * n + 1 > n + 3 THEN 'run starts before the row' ELSE 'run beyond the row''s bytes' END ELSE 'bytes after the end bit' END AS as_one,
                CASE k WHEN 1 THEN 'ok' WHEN 3 THEN 'run starts before the row' WHEN 4 THEN 'run beyond the width'
                    WHEN 5 THEN CASE WHEN 2 * n + 1 > n + 3 THEN 'run starts before the row' ELSE 'run beyond the row''s bytes' END ELSE 'run beyond the row''s bytes' END AS as_two FROM a""",
        "tile_draw": f"""SELECT l_orderkey, CAST(count(*) FILTER (v <> 0) AS INTEGER) AS visible, CAST(sum({_bits('v', 11, 31)}) AS BIGINT) AS red, CAST(sum({_bits('v', 5, 63)}) AS BIGINT) AS green, CAST(sum({_bits('v', 0, 31)}) AS BIGINT) AS blue
            FROM (SELECT l_orderkey, CAST({drawn} AS BIGINT) AS v FROM lineitem) GROUP BY 1""",
        "picture_draw": f"""SELECT p_partkey, CAST(1 - k // 2 AS INTEGER) AS y, CAST(sum({_bits('v', 10, 31)}) AS BIGINT) AS red, CAST(sum({_bits('v', 5, 31)}) AS BIGINT) AS green, CAST(sum({_bits('v', 0, 31)}) AS BIGINT) AS blue
            FROM (SELECT p_partkey, k, CAST((p_partkey * 37 + k * 1031) % 32768 AS BIGINT) AS v FROM part, range(4) AS r(k)) GROUP BY 1, 2""",
        "png_round_trip": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, raw, CASE WHEN octet_length(raw) = 0 THEN 4 ELSE (4 - octet_length(raw) % 4) % 4 END AS more FROM d)
            SELECT doc_id, CAST((octet_length(raw) + more) // 4 AS INTEGER) AS width, md5(raw || encode(repeat(' ', more))) AS md5 FROM p""",
        "png_chunks": """SELECT p_partkey, 'IHDR,IDAT,IEND' AS tags, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, true AS sound, CAST(h * (4 * w + 1) AS INTEGER) AS stream, CAST(4 * w * h * (p_partkey % 256) AS BIGINT) AS samples
            FROM (SELECT p_partkey, p_size % 9 + 1 AS w, p_partkey % 5 + 1 AS h FROM part)""",
        "catalog_parse": "SELECT 'AV' || p_partkey AS image_id, 'U' || p_partkey AS unit_id, 'part ' || p_partkey AS name, 'part ' || p_partkey AS description, CASE WHEN p_size % 2 = 0 THEN 'All,Monster' ELSE 'All' END AS uses FROM part",
        "record_route": f"SELECT p_partkey, {_record_rule(False)} AS some, {_record_rule(True)} AS every FROM (SELECT p_partkey, {_pick(NAMES, 'p_partkey')} || p_size AS name FROM part)",
        "presentation_route": f"""SELECT p_partkey, CASE WHEN starts_with(upper(name), 'QM') THEN 'maps/quest' WHEN starts_with(upper(name), 'MV') THEN 'cinematics' WHEN starts_with(upper(name), 'SPLH') THEN 'loading_screens' END AS category
            FROM (SELECT p_partkey, {_pick(['qm', 'MV', 'Splh', 'xx'], 'p_partkey')} || p_size AS name FROM part)""",
        "set_route": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {some} AS some, CASE WHEN c LIKE 'buildings/%' AND b NOT IN (80, 192, 208, 1) THEN 'other/main' ELSE c END AS every,
            CASE WHEN split_part(c, '/', 1) IN ('heroes', 'monsters', 'buildings') THEN CASE l_linenumber % 3 WHEN 0 THEN 'profile_art/' || split_part(c, '/', 1) WHEN 1 THEN 'icons/' || split_part(c, '/', 1) END END AS interface
            FROM (SELECT *, {_pick(['heroes/sprites', 'buildings/sprites', 'spell_effects', 'monsters/sprites', 'buildings/lairs'], 'l_partkey')} AS c, {_pick([1, 8, 16, 80, 128, 192, 208, 2200, 77], 'l_suppkey')} AS b FROM lineitem)""",
        "interface_fit": f"""SELECT p_partkey, CASE WHEN c LIKE 'profile_art%' THEN w >= 96 AND h >= 96 WHEN c LIKE 'icons%' THEN w BETWEEN 8 AND 128 AND h BETWEEN 8 AND 128 ELSE true END AS fits,
            c <> 'heroes/sprites' AS preserve, c = 'heroes/sprites' AS clean, c LIKE 'profile_art/%' AS opaque, c LIKE 'icons%' OR c LIKE 'menus%' AS enclosed
            FROM (SELECT p_partkey, p_size * 4 AS w, p_partkey % 150 AS h, {_pick(['profile_art/heroes', 'icons/spells', 'menus', 'heroes/sprites'], 'p_partkey')} AS c FROM part)""",
        "set_family": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 < 9 THEN p_partkey % 10 END AS INTEGER) AS place FROM part",
        "path_inside": "SELECT p_partkey, p_brand = 'Brand#11' AND p_size % 2 <> 0 AS inside FROM part",
        "bgr15_scale": f"SELECT event_id, CAST({_bits('v', 10, 31)} AS INTEGER) AS r, CAST({_bits('v', 5, 31)} AS INTEGER) AS g, CAST({_bits('v', 0, 31)} AS INTEGER) AS b FROM (SELECT event_id, CAST((event_id * 37) % 32768 AS BIGINT) AS v FROM events)",
    }
