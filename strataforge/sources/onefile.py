"""One file written by many tasks: ordered pieces get their byte offsets from distributed prefix sums.

Every task writes its own pieces into the file at their places, so order costs no single task and nothing passes through
the driver but two sums. The file has a name of its own until it is whole; a piece that is written twice is the same
both times. Files need a mounted file system, one that writes at an offset.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators import idioms as I
from strataforge.sources.files import located

#: Members' bytes that a task turns over at once.
BATCH_BYTES = 16 << 20


def mounted(path: str) -> str:
    system, place = located(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path} is not on a mounted file system")
    return place


def with_offsets(pieces: DataFrame, order: list[str], size: str, out: str = "at") -> DataFrame:
    """pieces in sorted chunks (_chunk, _at) with the sum of size over all pieces before each one."""
    rows = I.carried(I.chunked(pieces, [], order), [], F.sum(size), F.sum, "_before")
    inside = F.sum(size).over(I.inside_chunk([]).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce("_before", F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("_before")


def write_at(pieces: DataFrame, path: str, length: int, tail: bytes = b"", head: bytes = b"") -> None:
    """pieces (at, body) and what stands at the file's two ends; length is that of the whole file."""
    place = mounted(path)
    own = f"{place}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(place) or ".", exist_ok=True)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(own, "r+b") as file:
            for part in parts:
                for at, body in zip(part["at"], part["body"], strict=True):
                    if file.tell() != at:
                        file.seek(at)
                    file.write(body)
                yield pd.DataFrame({"n": [len(part)]})

    try:
        with open(own, "wb") as file:
            file.write(head)
            file.truncate(length)
            file.seek(length - len(tail))
            file.write(tail)
        pieces.select("at", "body").mapInPandas(work, "n long").agg(F.sum("n")).collect()
        os.replace(own, place)
    finally:
        if os.path.exists(own):
            os.unlink(own)


def write_lines(lines: DataFrame, order: list[str], path: str, head: bytes = b"") -> None:
    """lines (order, body) as one file, head first."""
    placed = I.written(with_offsets(lines.withColumn("_size", F.octet_length("body").cast("long")), order, "_size"), "lines")
    total = placed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    write_at(placed.sortWithinPartitions("at").select((F.col("at") + len(head)).alias("at"), "body"), path, len(head) + total, head=head)


# Fixed values of the archive format: signatures, versions, the date 1980-01-01, and the number that says "see the wide field".
LOCAL, CENTRAL, END, WIDE_END, WIDE_PLACE = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
DATE, WIDE, UTF8 = 0x21, 0xFFFFFFFF, 0x800


def local_record(name: bytes, crc: int, packed: int, size: int, method: int) -> bytes:
    return LOCAL + struct.pack("<5H3I2H", 20, UTF8, method, 0, DATE, crc, packed, size, len(name), 0) + name


def central_record(name: bytes, crc: int, packed: int, size: int, method: int, at: int) -> bytes:
    far = struct.pack("<HHQ", 1, 8, at) if at >= WIDE else b""
    return CENTRAL + struct.pack("<6H3I5H2I", 45, 45, UTF8, method, 0, DATE, crc, packed, size, len(name), len(far), 0, 0, 0, 0, min(at, WIDE)) + name + far


def end_records(count: int, at: int, size: int) -> bytes:
    wide = b""
    if count >= 0xFFFF or at >= WIDE or size >= WIDE:
        wide = WIDE_END + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, at) + WIDE_PLACE + struct.pack("<IQI", 0, at + size, 1)
    return wide + END + struct.pack("<4H2IH", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, WIDE), min(at, WIDE), 0)


def members(files: DataFrame, deflate: bool = True) -> DataFrame:
    """files (name, body) -> name, crc, size, packed, method, body (local record and data)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["name", "crc", "size", "packed", "method", "body"]
        for part in parts:
            out, held = [], 0
            for name, body in zip(part["name"], part["body"], strict=True):
                data = body
                if deflate:
                    one = zlib.compressobj(6, zlib.DEFLATED, -15)
                    data = one.compress(body) + one.flush()
                method = 8 if deflate else 0
                crc = zlib.crc32(body)
                out.append((name, crc, len(body), len(data), method, local_record(name.encode(), crc, len(data), len(body), method) + data))
                held += len(data)
                if held > BATCH_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    rows = files.where("name is not null and body is not null").select(F.col("name").cast("string").alias("name"), F.col("body").cast("binary").alias("body"))
    return rows.mapInPandas(work, "name string, crc long, size long, packed long, method int, body binary")


def write_zip(files: DataFrame, path: str, deflate: bool = True) -> DataFrame:
    """files (name, body) as one ZIP file, members in order of name; gives name, crc, size, packed and at of each member.

    Members are packed in tasks. Their places are prefix sums over the packed sizes, and those of the directory's records
    prefix sums over the records. Rows without a name or body are left out; members of one name are all written.
    """
    mounted(path)
    packed = I.written(members(files, deflate), "members").withColumn("_size", F.octet_length("body").cast("long"))
    placed = I.written(with_offsets(packed, ["name", "crc"], "_size"), "placed")

    def directory(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = zip(part["name"], part["crc"], part["packed"], part["size"], part["method"], part["at"], strict=True)
            yield pd.DataFrame({"name": part["name"], "at": part["at"], "body": [central_record(n.encode(), *r) for n, *r in rows]})

    records = placed.select("name", "crc", "packed", "size", "method", "at").mapInPandas(directory, "name string, at long, body binary")
    records = records.withColumnRenamed("at", "_member").withColumn("_size", F.octet_length("body").cast("long"))
    records = I.written(with_offsets(records, ["_member"], "_size"), "directory")
    count, data = placed.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    size = records.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    tail = end_records(count, data, size)
    pieces = placed.select("at", "body").union(records.select((F.col("at") + data).alias("at"), "body"))
    write_at(pieces.sortWithinPartitions("at"), path, data + size + len(tail), tail)
    return placed.select("name", "crc", "size", "packed", "at")
