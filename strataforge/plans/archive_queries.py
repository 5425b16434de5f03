"""Queries over the star-schema tables for whole archives, key-value texts, headers and raster steps.

As in binary_queries, bytes are laid out from columns, and each query's SQL computes what they must hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import raster, tiles
from strataforge.functions import scalars as S
from strataforge.operators import idioms as I
from strataforge.plans.binary_queries import le, orders_lines, parsed, t, together, zeros
from strataforge.plans.extraction import section_counts
from strataforge.sources import listing
from strataforge.sources.archive import MAGIC, entries_of


def content_of() -> Column:
    """An archive's bytes from lines: section REC holds l_partkey of each line, TILE l_suppkey and l_linenumber."""
    n = F.size("lines")
    end = 52 + 56 * n  # magic, two numbers, two sections of eight bytes, their lists
    name = lambda letter, x: F.concat(F.encode(F.concat(F.lit(letter), x["l_linenumber"].cast("string")), "US-ASCII"), zeros(19 - F.length(x["l_linenumber"].cast("string"))))
    first = F.transform("lines", lambda x, i: F.concat(name("R", x), le(end + 4 * i, 4), le(F.lit(4), 4)))
    second = F.transform("lines", lambda x, i: F.concat(name("T", x), le(end + 4 * n + 6 * i, 4), le(F.lit(6), 4)))
    lists = [F.concat(le(n, 4), zeros(4), together(first)), F.concat(le(n, 4), zeros(4), together(second))]
    heads = F.concat(F.lit(b"REC "), le(F.lit(36), 4), F.lit(b"TILE"), le(44 + 28 * n, 4))
    body = F.concat(together(F.transform("lines", lambda x: le(x["l_partkey"], 4))), together(F.transform("lines", lambda x: F.concat(le(x["l_suppkey"], 4), le(x["l_linenumber"], 2)))))
    return F.concat(F.lit(MAGIC), le(F.lit(2), 4), le(16 + 56 * n, 4), heads, *lists, body)


def order_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each order, as files (path, content)."""
    return orders_lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("path"), content_of().alias("content"))


def archive_entries(spark, sf_dir):
    """Every entry of every order's archive, with its bytes."""
    rows = entries_of(order_archives(spark, sf_dir))
    return rows.select(F.col("source").cast("long").alias("l_orderkey"), "section_ord", "ext", "entry_ord", "display_name", "data_offset", "data_size", F.hex("data").alias("data"))


def archive_sections(spark, sf_dir):
    """Entries and bytes by archive and section."""
    rows = section_counts(entries_of(order_archives(spark, sf_dir)))
    return rows.select(F.col("source").cast("long").alias("l_orderkey"), "section_ord", "ext", "entries", "bytes")


def tile_header_words(spark, sf_dir):
    """The header's fields of a tile."""
    fields = [le(F.lit(3), 2), le(F.col("p_size"), 2), le(F.col("p_partkey") % 60_000, 2), *[le((F.col("p_partkey") * k) % 65_536, 2) for k in range(3, 8)], zeros(6), le(F.col("p_partkey") * 5, 4)]
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(*fields).alias("data"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in S.header_words(F.col("data")).items()])


def video_header(spark, sf_dir):
    """Evenly spread frames and the size of a video's header; none where the mark is not a video's or a size is out of bounds."""
    mark = F.when(F.col("event_id") % 5 == 0, F.lit(b"XIK")).otherwise(F.lit(b"BIK"))
    header = F.concat(zeros(4), mark, zeros(5), le(F.col("event_id") % 40, 4), zeros(8), le(F.col("event_id") % 9000, 4), le(F.col("user_id") % 700 + 1, 4))
    rows = t(spark, sf_dir, "events").select("event_id", header.alias("header"))
    size = listing.video_size(F.col("header"))
    return rows.select("event_id", F.array_join(listing.even_frames(F.col("header")).cast("array<string>"), ",").alias("frames"), size["width"].alias("width"), size["height"].alias("height"))


def key_value_paths(spark, sf_dir):
    """The first and all paths of a key-value text, one for each line of an order."""
    line = lambda x: F.concat(F.lit('\t"path"\t\t"D:\\\\lib'), x["l_partkey"].cast("string"), F.lit('"\n\t"label"\t\t"'), x["l_linenumber"].cast("string"), F.lit('"\n'))
    rows = orders_lines(spark, sf_dir).select("l_orderkey", F.array_join(F.transform("lines", line), "").alias("text"))
    return rows.select("l_orderkey", listing.quoted_value(F.col("text"), "path").alias("first"), F.array_join(listing.quoted_values(F.col("text"), "path"), ";").alias("paths"))


def key_colours(spark, sf_dir):
    """Whether an indexed colour stands for see-through or shadow."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    index, r, g, b = (F.col("l_orderkey") + F.col("l_linenumber")) % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 100, (F.col("l_partkey") + F.col("l_suppkey") % 50) % 256
    return rows.withColumn("is_key", S.is_key_colour(index, r, g, b))


def palette_parse(spark, sf_dir):
    """Colour sums and control colours of a palette."""
    value = lambda i: F.concat(le((F.col("p_partkey") * 7 + i * 13) % 256, 1), le((F.col("p_partkey") + i * 3) % 128, 1), le((F.col("p_partkey") * 7 + i * 11) % 256, 1), zeros(1))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(zeros(8), together(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), value))).alias("palette"))

    def work(r) -> list[tuple]:
        colours = tiles.palette(r.palette, exact=True)
        return [(r.p_partkey, *colours.astype(int).sum(axis=0).tolist(), int(tiles.key_colours(colours).sum()))]

    return parsed(rows, work, "p_partkey long, red long, green long, blue long, controls int")


def _line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and one-row images as arrays: a part's number and a supplier's for each line."""
    return orders_lines(spark, sf_dir).select("l_orderkey", F.transform("lines", lambda x: x["l_partkey"]).alias("part"), F.transform("lines", lambda x: x["l_suppkey"]).alias("supp"))


def _rgba(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    out = np.zeros((1, len(colour), 4), np.uint8)
    out[0, :, 0], out[0, :, 3] = colour % 256, alpha % 256
    return out


def image_composite(spark, sf_dir):
    """Sums of red and alpha of one one-row image over another, a pixel for each line of an order."""

    def work(r) -> list[tuple]:
        part, supp = np.array(r.part, np.int64), np.array(r.supp, np.int64)
        canvas = _rgba(part, supp * 3)
        raster.composite(canvas, _rgba(supp, part * 5))
        return [(r.l_orderkey, int(canvas[..., 0].astype(int).sum()), int(canvas[..., 3].astype(int).sum()))]

    return parsed(_line_pixels(spark, sf_dir), work, "l_orderkey long, red long, alpha long")


def image_box(spark, sf_dir):
    """Visible bounds, width once cropped and preview score of a one-row image, where every third part is visible; -1 if none is."""

    def work(r) -> list[tuple]:
        part = np.array(r.part, np.int64)
        image = _rgba(part, np.where(part % 3 == 0, 255, 0))
        box = raster.bbox(image[..., 3]) or (-1, -1, -1, -1)
        return [(r.l_orderkey, box[0], box[2], raster.cropped(image).shape[1], raster.score(image))]

    return parsed(_line_pixels(spark, sf_dir), work, "l_orderkey long, left_at int, right_at int, width int, score int")


def image_shrink(spark, sf_dir):
    """Two pixels shrunk to one: colours weighted by alpha."""
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_size")

    def work(r) -> list[tuple]:
        one = raster.resize(_rgba(np.array([r.p_partkey, r.p_partkey * 3]), np.array([r.p_size, r.p_partkey * 7])), 1, 1)
        return [(r.p_partkey, int(one[0, 0, 0]), int(one[0, 0, 3]))]

    return parsed(rows, work, "p_partkey long, red int, alpha int")


def variant_index(spark, sf_dir):
    """Numbers of an order's lines that are left once small ones are filtered."""
    rows = t(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return I.positions(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], out="variant")


_ALL = (archive_entries, archive_sections, tile_header_words, video_header, key_value_paths, key_colours, palette_parse, image_composite, image_box, image_shrink, variant_index)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _le_hex(v: str, size: int) -> str:
    return " || ".join(f"printf('%02X', (({v}) >> {8 * i}) & 255)" for i in range(size))


def oracle_sql() -> dict[str, str]:
    lines = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
    even = "list_transform(range(CAST(k AS BIGINT)), lambda i: CAST(CASE WHEN k = 1 THEN 0 ELSE round_even(i * (n - 1) / (k - 1), 0) END AS INTEGER))"
    p, s = "CAST(l_partkey AS BIGINT)", "CAST(l_suppkey AS BIGINT)"
    words = ", ".join(f"CAST((p_partkey * {k}) % 65536 AS BIGINT) AS w{k}" for k in range(3, 8))
    return {
        "archive_entries": f"""SELECT l_orderkey, 0 AS section_ord, 'REC' AS ext, CAST(i AS INTEGER) AS entry_ord, 'R' || l_linenumber AS display_name, 52 + 56 * n + 4 * i AS data_offset, CAST(4 AS BIGINT) AS data_size, {_le_hex(p, 4)} AS data FROM {lines}
            UNION ALL SELECT l_orderkey, 1, 'TILE', CAST(i AS INTEGER), 'T' || l_linenumber, 52 + 60 * n + 6 * i, CAST(6 AS BIGINT), {_le_hex(s, 4)} || {_le_hex('CAST(l_linenumber AS BIGINT)', 2)} FROM {lines}""",
        "archive_sections": """SELECT l_orderkey, 0 AS section_ord, 'REC' AS ext, count(*) AS entries, 4 * count(*) AS bytes FROM lineitem GROUP BY 1
            UNION ALL SELECT l_orderkey, 1, 'TILE', count(*), 6 * count(*) FROM lineitem GROUP BY 1""",
        "tile_header_words": f"SELECT p_partkey, CAST(p_size AS BIGINT) AS height, CAST(p_partkey % 60000 AS BIGINT) AS width, {words}, CAST(p_partkey * 5 AS BIGINT) AS palette_id FROM part",
        "video_header": f"""WITH v AS (SELECT event_id, event_id % 5 <> 0 AS good, event_id % 40 AS n, event_id % 9000 AS w, user_id % 700 + 1 AS h FROM events), k AS (SELECT *, least(n, 12) AS k FROM v)
            SELECT event_id, CASE WHEN good AND n > 0 THEN array_to_string(list_sort(list_distinct({even})), ',') ELSE '' END AS frames,
                CASE WHEN good AND w BETWEEN 1 AND 8192 THEN w END AS width, CASE WHEN good AND w BETWEEN 1 AND 8192 THEN h END AS height FROM k""",
        "key_value_paths": rf"SELECT l_orderkey, min(CASE WHEN i = 0 THEN 'D:\lib' || l_partkey END) AS first, string_agg('D:\lib' || l_partkey, ';' ORDER BY i) AS paths FROM {lines} GROUP BY 1",
        "key_colours": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k BETWEEN 247 AND 250 OR (r > 150 AND g < 80 AND b > 150 AND abs(r - b) < 60) OR (g = 0 AND r = b AND r BETWEEN 120 AND 140) AS is_key
            FROM (SELECT *, (l_orderkey + l_linenumber) % 256 AS k, l_partkey % 256 AS r, l_suppkey % 100 AS g, (l_partkey + l_suppkey % 50) % 256 AS b FROM lineitem)""",
        "palette_parse": """SELECT p_partkey, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue,
            CAST(count(*) FILTER (i BETWEEN 247 AND 250 OR (r > 150 AND g < 80 AND b > 150 AND abs(r - b) < 60) OR (g = 0 AND r = b AND r BETWEEN 120 AND 140)) AS INTEGER) AS controls
            FROM (SELECT p_partkey, i, (p_partkey * 7 + i * 13) % 256 AS r, (p_partkey + i * 3) % 128 AS g, (p_partkey * 7 + i * 11) % 256 AS b FROM part, range(256) AS x(i)) GROUP BY 1""",
        "image_composite": f"""WITH a AS (SELECT l_orderkey, {p} % 256 AS c, {s} * 3 % 256 AS da, {s} % 256 AS o, {p} * 5 % 256 AS sa FROM lineitem), b AS (SELECT *, da * (255 - sa) // 255 AS rest FROM a)
            SELECT l_orderkey, CAST(sum((o * sa + c * rest) // greatest(sa + rest, 1)) AS BIGINT) AS red, CAST(sum(sa + rest) AS BIGINT) AS alpha FROM b GROUP BY 1""",
        "image_box": f"""WITH a AS (SELECT l_orderkey, max(n) AS n, min(CASE WHEN l_partkey % 3 = 0 THEN i END) AS lo, max(CASE WHEN l_partkey % 3 = 0 THEN i + 1 END) AS hi, count(*) FILTER (l_partkey % 3 = 0) AS seen FROM {lines} GROUP BY 1)
            SELECT l_orderkey, CAST(coalesce(lo, -1) AS INTEGER) AS left_at, CAST(coalesce(hi, -1) AS INTEGER) AS right_at, CAST(coalesce(hi - lo, n) AS INTEGER) AS width, CAST(coalesce(hi - lo + seen, 0) AS INTEGER) AS score FROM a""",
        "image_shrink": """WITH a AS (SELECT p_partkey, p_partkey % 256 AS c, p_size % 256 AS x, p_partkey * 3 % 256 AS d, p_partkey * 7 % 256 AS y FROM part)
            SELECT p_partkey, CAST((c * x + d * y) // greatest(x + y, 1) AS INTEGER) AS red, CAST((x + y) // 2 AS INTEGER) AS alpha FROM a""",
        "variant_index": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS variant
            FROM lineitem WHERE l_quantity > 10""",
    }
