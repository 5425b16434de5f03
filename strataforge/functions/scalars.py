"""Column functions: names, paths, packed integers and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """A safe file name of ASCII letters, digits and ._-: NUL goes, runs of anything else and of spaces become _, no ._- at the ends, never empty."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "[^A-Za-z0-9._ -]+", "_"), " +", "_")
    ends = F.regexp_replace(plain, "^[._-]+|[._-]+$", "")
    return F.coalesce(F.when(ends != "", ends), F.lit("unnamed"))


def base_id(set_id: Column) -> Column:
    """The low 16 bits, unless they are 0."""
    low = set_id.bitwiseAND(F.lit(65535))
    return F.when(low == 0, set_id).otherwise(low)


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def scaled(value: Column, most: int) -> Column:
    """0..most to 0..255, rounded down; in whole numbers."""
    return ((value * 255 - (value * 255) % most) / most).cast("int")


def rgb565(value: Column) -> tuple[Column, Column, Column]:
    return scaled(bits(value, 11, 5), 31), scaled(bits(value, 5, 6), 63), scaled(bits(value, 0, 5), 31)


def bgr15(value: Column) -> tuple[Column, Column, Column]:
    """Red stands in bits 14 to 10."""
    return scaled(bits(value, 10, 5), 31), scaled(bits(value, 5, 5), 31), scaled(bits(value, 0, 5), 31)


def le_uint(data: Column, offset: Column | int, size: int) -> Column:
    """An unsigned little-endian integer at a byte offset of a BINARY; null beyond its end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    raw = F.hex(F.substr(data, (at + 1).cast("int"), F.lit(size)))
    turned = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.octet_length(data) >= at + size, F.conv(turned, 16, 10).cast("long"))


def header_words(tile: Column) -> dict[str, Column]:
    """The fields of a tile's header by name; null where the tile is too short for one."""
    at = {"height": 2, "width": 4, "w3": 6, "w4": 8, "w5": 10, "w6": 12, "w7": 14}
    return {name: le_uint(tile, offset, 2) for name, offset in at.items()} | {"palette_id": le_uint(tile, 22, 4)}


def is_key_colour(index: Column, r: Column, g: Column, b: Column) -> Column:
    """Colours that stand for see-through or shadow in palettes."""
    ramp = (r > 150) & (g < 80) & (b > 150) & (F.abs(r - b) < 60)
    return index.between(247, 250) | ramp | ((g == 0) & (r == b) & r.between(120, 140))


def set_name(set_id: Column, exact: Column, low: Column) -> Column:
    """The id's own name, else its low half's with the high half, else set-<id>."""
    return F.coalesce(exact, F.concat(low, F.lit("-"), F.shiftright(set_id, 16).cast("string")), F.concat(F.lit("set-"), set_id.cast("string")))


def padded(number: Column, width: int) -> Column:
    """A number of 0 or more with zeros in front, up to a width."""
    return F.when(number < 10**width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string"))


def frame_path(folder: Column, direction: Column, frame: Column, tile: Column) -> Column:
    return F.concat(folder, F.lit("_dir"), direction.cast("string"), F.lit("_frame"), padded(frame, 3), F.lit("_tile"), padded(tile, 5), F.lit(".png"))


def cell_label(name: Column, direction: Column, frame: Column, width: int = 24) -> Column:
    filled = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c))
    label = F.concat_ws(" ", F.when(name != "", name), filled("d", direction), filled("f", frame))
    return F.substring(F.coalesce(F.when(label != "", label), F.lit("frame")), 1, width)


def format_bytes(n: Column) -> Column:
    """1024-based units with one decimal; tenths are rounded half to even on the exact ratio."""
    n = F.greatest(n, F.lit(0)).cast("long")
    out = None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        tenths = F.bround(n.cast("decimal(38,10)") * 10 / F.lit(1024**power).cast("decimal(20,0)"), 0).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = text if out is None else F.when(n < 1024 ** (power + 1), text).otherwise(out)
    return out


def inside(path: Column, parent: Column) -> Column:
    """Containment by whole path components, whatever the case."""
    clean = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    return (clean(path) == clean(parent)) | F.startswith(F.lower(path), F.concat(clean(parent), F.lit("/")))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the text holds any of the terms, whatever the case; terms are plain text."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(x.lower())) for x in terms], F.lit(False))


def even_positions(n: Column, most: int) -> Column:
    """Up to `most` positions of 0..n-1, evenly spread, first and last included, sorted and distinct."""
    k = F.least(n, F.lit(most)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n < 1, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(spread)))
