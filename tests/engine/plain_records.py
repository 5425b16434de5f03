"""One record at a time, byte by byte: what the batch decoders are held against."""

import struct


def u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def sets(blob: bytes) -> list[tuple[int, int, int]]:
    """(id, start, end) of each set; all or nothing. The end is the next set's start as listed, else the record's end."""
    if len(blob) < 24 or not 1 <= (n := u32(blob, 20)) <= 256 or 24 + 8 * n > len(blob):
        return []
    pairs = [struct.unpack_from("<II", blob, 24 + 8 * i) for i in range(n)]
    if any(start >= len(blob) for _, start in pairs):
        return []
    ends = [start for _, start in pairs[1:]] + [len(blob)]
    return [(i, start, end) for (i, start), end in zip(pairs, ends, strict=True)]


def directions(blob: bytes, start: int) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(slot, x, y, width, height, tiles) of up to eight directions; a direction of none or over 128 frames is left out.

    A direction's frames go up to the next populated one; the last's go on while the flag is 0 and the tile plausible.
    """
    if start + 0x58 > len(blob):
        return []
    used = [(slot, off) for slot, off in enumerate(struct.unpack_from("<8i", blob, start + 0x38)) if off > 0]
    out = []
    for k, (slot, off) in enumerate(used):
        at = start + off
        if at + 28 > len(blob):
            continue
        x, y, w, h = struct.unpack_from("<hhHH", blob, at + 20)
        pairs = [struct.unpack_from("<II", blob, p) for p in range(at + 0x30, min(at + 0x30 + 128 * 8, len(blob) - 7), 8)]
        if k + 1 < len(used):
            n = (used[k + 1][1] - off - 0x30) // 8
        else:
            n = next((i for i, (flag, tile) in enumerate(pairs) if flag or not 0 < tile < 500_000), len(pairs))
        if 0 < n <= 128:
            out.append((slot, x, y, w, h, [tile for _, tile in pairs[:n]]))
    return out


def scan(blob: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, number) of all 32-bit numbers of an interface set, from where its tiles may begin."""
    if not 0 <= start < end <= len(blob):
        return []
    first = start + 80
    if start + 68 <= end and start < start + u32(blob, start + 64) < end:
        first = max(first, start + u32(blob, start + 64) + 20)
    return [(at, u32(blob, at)) for at in range(first, end - 3, 4)]


def state_walk(blob: bytes, start: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """How many tiles a building's set asks for, and (offset, tile) of the pairs (0, tile), last first."""
    if not 0 <= start < end <= len(blob) or end - start < 100:
        return 0, []
    found = []
    for at in range(end - 4, start + 87, -4):
        if u32(blob, at) and (u32(blob, at - 4) if at - 4 >= start else 0) == 0:
            found.append((at, u32(blob, at)))
    return max(1, min(32, u16(blob, start + 74))), found
