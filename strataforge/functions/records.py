"""What records of one kind leave to a walk in order, and the rows of catalogue files."""

from __future__ import annotations

from collections.abc import Iterator


def walked(want: int, pairs: list[tuple[int, int]], fits: dict[int, bool]) -> list[int]:
    """Tiles taken from the end backward: a hit skips the pair, a miss one number; given back in file order."""
    out: list[int] = []
    limit = None
    for at, tile in pairs:
        if len(out) == want:
            break
        if (limit is None or at <= limit) and tile not in out and fits.get(tile, False):
            out.append(tile)
            limit = at - 8
    return out[::-1]


def catalog_rows(xml: str) -> Iterator[tuple[str, str, str, str, list[str]]]:
    """(image id, unit id, name, description, uses) of each Description that has an image."""
    from xml.etree import ElementTree

    for node in ElementTree.fromstring(xml).iterfind(".//Description"):
        image = node.find(".//ImageIDBase")
        if image is not None and "value" in image.attrib:
            key = image.attrib["value"]
            name = node.get("Name", key)
            yield key, node.get("ID", ""), name, node.get("Description", name), sorted({u.get("value", "") for u in node.iterfind(".//CanUse")})
