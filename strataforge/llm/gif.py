"""Media columns for GIF: encode, decode and describe frames.

A GIF column is decoded to timed frames: LZW code streams, global and local palettes, interlacing, transparency and the
three disposal rules. Nothing leaves a task but rows, and each row is one file or one frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

FULL = 4096
FRAME_SCHEMA = "frame int, delay_ms int, left int, top int, width int, height int, samples binary, rgba binary, histogram array<long>"
PAYLOAD_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"


@dataclass
class Frame:
    """One image of the file: its samples as stored, and the canvas as shown."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    samples: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray | None = None


@functools.lru_cache
def code_widths(bits: int, n: int) -> np.ndarray:
    """Width of the j-th code after a clear code, for a minimum code size of bits."""
    j = np.arange(n)
    return np.minimum(12, np.floor(np.log2(np.maximum((1 << bits) + 1 + j, 1))).astype(np.int64) + 1).astype(np.int64)


@functools.cache
def pair_table() -> list[int]:
    """The encoder's table by code << 8 | sample, all zero between two calls: one for each worker."""
    return [0] * (FULL << 8)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's LZW code stream, with a clear code at the start and wherever the table is full."""
    clear = 1 << bits
    # Codes are kept shifted by 8; pairs holds, for each table, the pair that ended each code.
    start, stop = clear + 2 << 8, FULL - 1 << 8
    parts, pairs = [[clear]], []
    table = pair_table()
    it = iter(data)
    w = next(it, None)
    if w is None:
        parts.append([clear + 1])
    else:
        append, free = pairs.append, start
        w <<= 8
        try:
            for c in it:
                k = w | c
                x = table[k]
                if x:
                    w = x
                else:
                    append(k)
                    table[k] = free
                    free += 256
                    w = c << 8
                    if free == stop:
                        parts.append(np.append(np.array(pairs) >> 8, clear))
                        for k in pairs:
                            table[k] = 0
                        pairs.clear()
                        free = start
        finally:
            for k in pairs:
                table[k] = 0
        parts.append(np.append(np.array(pairs, np.int64) >> 8, (w >> 8, clear + 1)))
    width = np.concatenate([code_widths(bits, FULL)[: len(part)] for part in parts])
    grid = np.unpackbits(np.concatenate(parts).astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(grid[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_codes(stream: bytes, bits: int) -> Iterator[np.ndarray]:
    """The codes of each table of a code stream, without clear and end codes."""
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    have, at, clear = len(stream) * 8, 0, 1 << bits
    found: list[np.ndarray] = []
    seen = 0  # codes since the last clear code
    while True:
        width = code_widths(bits, 2 * FULL)[min(seen, FULL) : min(seen, FULL) + FULL]
        ends = at + np.cumsum(width)
        n = int(np.searchsorted(ends, have, "right"))
        if not n:
            break
        width, ends = width[:n], ends[:n]
        starts = ends - width
        i = starts >> 3
        codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (starts & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stops):
            found.append(codes)
            at, seen = int(ends[-1]), seen + n
            continue
        stop = int(stops[0])
        found.append(codes[:stop])
        yield np.concatenate(found)
        if codes[stop] == clear + 1:
            return
        at, seen, found = int(ends[stop]), 0, []
    if found:
        yield np.concatenate(found)


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The samples of a code stream, size at most; ValueError for a code that can't be there.

    The table's j-th own entry is what the j-th code since the clear code stands for and the sample after it. So each
    sample is either a code of its own or stands earlier in the output, and pointers to it are followed in doubled steps.
    """
    first, out, made = (1 << bits) + 2, [], 0
    for codes in lzw_codes(stream, bits):
        if made >= size:
            break
        at = np.arange(len(codes))
        own = codes < first
        entry = np.where(own, at, codes - first)
        bad = np.flatnonzero(~own & (entry >= at))
        if len(bad):
            raise ValueError(f"LZW code {codes[bad[0]]} of {min(FULL, first + max(0, int(bad[0]) - 1))}")
        length, up = np.where(own, 0, 1), entry
        while (more := length[up]).any():
            length = length + more
            up = up[up]
        length += 1
        ends = np.cumsum(length)
        n = min(len(codes), int(np.searchsorted(ends, size - made)) + 1)
        length, begin = length[:n], ends[:n] - length[:n]
        place = np.arange(ends[n - 1] if n else 0)
        source = place + np.repeat(begin[entry[:n]] - begin, length)
        while not np.array_equal(further := source[source], source):
            source = further
        samples = np.zeros(len(place), np.uint8)
        samples[begin] = codes[:n] & 0xFF
        out.append(samples[source].tobytes())
        made += len(place)
    return b"".join(out)[:size]


@functools.cache
def grey_palette() -> np.ndarray:
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    grey.setflags(write=False)
    return grey


def encode_gif(samples: bytes, width: int, *, rows: int = 64, delay_ms: int = 100, palette: np.ndarray | None = None) -> bytes:
    """A GIF whose frames hold samples (a multiple of width) in order, rows lines each."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole lines")
    total = len(samples) // width
    colours = (grey_palette() if palette is None else palette).astype(np.uint8).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, total), 0xF7, 0, 0), colours]
    for top in range(0, total, rows):
        part = samples[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<HB", delay_ms // 10, 0) + b"\x00")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(block)]) + block for block in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes, *, render: bool = True) -> list[Frame]:
    """Frames in order; render: also what the canvas shows when each is up. ValueError if the bytes aren't a whole GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _frames(data, render)
    except (IndexError, struct.error) as cause:
        raise ValueError("the GIF is cut short") from cause


def _frames(data: bytes, render: bool) -> list[Frame]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, grey_palette()

    def colours(flag: int, at: int, default: np.ndarray) -> tuple[np.ndarray, int]:
        if not flag & 0x80:
            return default, at
        n = 2 << (flag & 7)
        if at + 3 * n > len(data):
            raise IndexError
        full = np.zeros((256, 3), np.uint8)
        full[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return full, at + 3 * n

    palette, at = colours(flags, at, palette)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, clear_index = 0, 0, None
    while (mark := data[at]) != 0x3B:
        at += 1
        if mark == 0x21:
            label = data[at]
            block, at = sub_blocks(data, at + 1)
            if label == 0xF9 and len(block) >= 4:
                packed, cs, index = struct.unpack_from("<BHB", block)
                delay, disposal, clear_index = cs * 10, packed >> 2 & 7, index if packed & 1 else None
        elif mark == 0x2C:
            left, top, w, h, flag = struct.unpack_from("<HHHHB", data, at)
            own, at = colours(flag, at + 9, palette)
            bits = data[at]
            stream, at = sub_blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
            if len(samples) != w * h:
                raise ValueError("a frame lacks samples")
            samples = samples.reshape(h, w)
            if flag & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                lines = np.empty_like(samples)
                lines[order] = samples
                samples = lines
            frame = Frame(left, top, w, h, delay, samples, own)
            if render:
                before = canvas.copy() if disposal == 3 else None
                view = canvas[top : top + h, left : left + w]
                part = samples[: view.shape[0], : view.shape[1]]
                shades = np.append(own, np.full((256, 1), 255, np.uint8), axis=1)
                if clear_index is None:
                    view[:] = shades.take(part, axis=0)
                else:
                    shown = part != clear_index
                    view[shown] = shades[part[shown]]
                frame.canvas = canvas.copy()
                if disposal == 2:
                    view[:] = 0
                elif disposal == 3:
                    canvas = before
            frames.append(frame)
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError(f"block {mark:#x}")
    return frames


def histogram(frame: Frame, bins: int = 16) -> np.ndarray:
    """What a rendered frame shows in its own rectangle: pixels by red, then by green, then by blue, bins each.

    Pixels that nothing has covered yet count nowhere.
    """
    shown = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width].reshape(-1, 4)
    if not shown[:, 3].all():
        shown = shown[shown[:, 3] > 0]
    first = -(-np.arange(bins) * 256 // bins)  # the least shade of each bin
    return np.concatenate([np.add.reduceat(np.bincount(shown[:, i], minlength=256), first) for i in range(3)])


def frame_table(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row per frame of each GIF in media_col: id and FRAME_SCHEMA. Null or broken files give no row. Repeated ids are kept apart only by their rows."""
    kind = dict(df.dtypes)[id_col]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, data in zip(part["_id"], part["_media"], strict=True):
                try:
                    frames = decode_gif(bytes(data)) if data is not None else []
                except ValueError:
                    frames = []
                rows = [(key, i, f.delay_ms, f.left, f.top, f.width, f.height, f.samples.tobytes(), f.canvas.tobytes(), histogram(f).tolist()) for i, f in enumerate(frames)]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "frame", "delay_ms", "left", "top", "width", "height", "samples", "rgba", "histogram"])

    return df.select(df[id_col].alias("_id"), df[media_col].alias("_media")).mapInPandas(work, f"id {kind}, {FRAME_SCHEMA}")


def payload(text: str | None, unit: int = 576) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes filled up with 255 to a positive multiple of unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 576, keep_media: bool = False) -> DataFrame:
    """Stores each text as a GIF, reads it back and describes what was read: doc_id and PAYLOAD_SCHEMA (and media).

    feature: the colour histogram of all frames as shown, 16 bins each of red, green and blue, comma-joined.

    Null and empty texts store one line of 255. Repeated rows and equal texts give equal values; an empty table an empty one.
    """
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, text in zip(part["_id"], part["_text"], strict=True):
                n, samples = payload(text, width)
                media = encode_gif(samples, width)
                frames = decode_gif(media)
                back = b"".join(f.samples.tobytes() for f in frames)
                colours = sum(histogram(f) for f in frames)
                feature = ",".join(map(str, colours.tolist()))
                row = (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames))
                rows.append((*row, media) if keep_media else row)
            names = ["doc_id", *(x.split()[0] for x in PAYLOAD_SCHEMA.split(", "))] + ["media"] * keep_media
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = part["_id"].values
            yield out

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInPandas(work, f"doc_id {kind}, {PAYLOAD_SCHEMA}" + ", media binary" * keep_media)
