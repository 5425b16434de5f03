"""Sharding by fixed virtual slots: rows are hashed into thousands of slots, and a stored map says which shard a slot is in.

A slot's number never changes; only the map does. Each edit of it is a new version, and the older ones stay. Rebalancing
moves as few slots as it can until the shards' bytes are near equal; growing moves slots into the new shard alone. The
map has a row for each slot, and more only for slots that outweigh a fixed share of a shard, so its size is bounded
whatever the table holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_sums, sorted_chunks, stage, unstage

SCHEMA = "version int, virtual_slot int, part int, bytes long, shard int"


@dataclass
class SlotMap:
    """Entries (slot, part of a heavy slot), their bytes, and each version's shards by entry; the last version holds."""

    slots: np.ndarray
    parts: np.ndarray
    bytes: np.ndarray
    versions: list[np.ndarray] = field(default_factory=list)

    @property
    def shards(self) -> np.ndarray:
        return self.versions[-1]

    def loads(self, n: int) -> np.ndarray:
        return np.bincount(self.shards, self.bytes, n).astype(np.int64)

    def store(self, spark: SparkSession) -> DataFrame:
        """All versions as a table in the shared folder."""
        rows = [(v, *entry) for v, shards in enumerate(self.versions, 1) for entry in zip(self.slots.tolist(), self.parts.tolist(), self.bytes.tolist(), shards.tolist(), strict=True)]
        return stage(spark.createDataFrame(rows, SCHEMA).coalesce(1), "slot-map")


def read_map(stored: DataFrame) -> SlotMap:
    rows = stored.orderBy("version", "virtual_slot", "part").toPandas()
    first = rows[rows["version"] == 1]
    return SlotMap(*(first[c].to_numpy() for c in ("virtual_slot", "part", "bytes")), [g["shard"].to_numpy() for _, g in rows.groupby("version")])


def parts_of(slot_bytes: dict[int, int], shards: int, grain: int) -> dict[int, int]:
    """Into how many parts a slot over 1 / grain of a mean shard is cut, by slot."""
    share = max(1, sum(slot_bytes.values()) // (shards * grain))
    return {s: -(-n // share) for s, n in slot_bytes.items() if n > share}


def new_map(entry_bytes: dict[tuple[int, int], int], parts: dict[int, int], slots: int, shards: int) -> SlotMap:
    """Version 1 deals slots, and the parts of heavy ones, round."""
    slot, part = np.array([(s, p) for s in range(slots) for p in range(parts.get(s, 1))], np.int64).T
    size = np.array([entry_bytes.get(e, 0) for e in zip(slot.tolist(), part.tolist(), strict=True)], np.int64)
    return SlotMap(slot, part, size, [(slot + part) % shards])


def rebalance(m: SlotMap, shards: int, most_edits: int = 100_000) -> None:
    """Adds a version: while it narrows the gap, the fullest shard hands an entry to the emptiest or swaps one with it."""
    now = m.shards.copy()
    loads = m.loads(shards)
    for _ in range(most_edits):
        high, low = int(loads.argmax()), int(loads.argmin())
        gap = int(loads[high] - loads[low])
        give, take = np.flatnonzero((now == high) & (m.bytes > 0)), np.flatnonzero((now == low) & (m.bytes > 0))
        sizes = np.append(0, m.bytes[take])  # nothing, or an entry, comes back
        order = np.argsort(sizes, kind="stable")
        at = np.searchsorted(sizes[order], m.bytes[give] - gap // 2)
        best = (gap, -1, -1)
        for shift in (-1, 0):
            j = order[np.clip(at + shift, 0, len(order) - 1)]
            left = np.abs(gap - 2 * (m.bytes[give] - sizes[j]))
            if len(left) and left.min() < best[0]:
                i = int(left.argmin())
                best = (int(left[i]), int(give[i]), int(take[j[i] - 1]) if j[i] else -1)
        if best[1] < 0:
            break
        moved = int(m.bytes[best[1]]) - (int(m.bytes[best[2]]) if best[2] >= 0 else 0)
        now[best[1]] = low
        if best[2] >= 0:
            now[best[2]] = high
        loads[high] -= moved
        loads[low] += moved
    m.versions.append(now)


def grow(m: SlotMap, shards: int) -> None:
    """Adds a version with shard number `shards`, which takes entries from the fullest shards until it has its share; nothing else moves."""
    now = m.shards.copy()
    loads = m.loads(shards + 1)
    share = int(m.bytes.sum()) // (shards + 1)
    while loads[shards] < share:
        for high in np.argsort(-loads[:shards], kind="stable"):
            fits = np.flatnonzero((now == high) & (m.bytes > 0) & (m.bytes <= share - loads[shards]))
            if len(fits):
                pick = fits[m.bytes[fits].argmax()]
                now[pick] = shards
                loads[high] -= m.bytes[pick]
                loads[shards] += m.bytes[pick]
                break
        else:
            break
    m.versions.append(now)


def shard(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = 4096, grain: int = 32, overhead: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, map): each row's doc_id, size, text_crc32, virtual_slot, shard and place (gapless in its shard), and the stored map.

    Rows are hashed by id. Rows of a slot that is heavier than 1 / grain of a mean shard are dealt over the entries
    that the map has for it, so neither an id nor a text that a third of all rows share weighs down one shard. Null
    texts are empty, null ids one id; repeated rows are placed each. Two rows of one id may be in two shards only where
    its slot is heavy. An empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit(""))), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("_n"),
    )
    rows = staged = stage(rows, "shard-rows")
    weights = dict(rows.groupBy("virtual_slot").agg(F.sum("size")).collect())  # slots rows at most
    parts = parts_of(weights, shards, grain)  # grain * shards parts of heavy slots at most, and one more for each of them
    known = F.broadcast(spark.createDataFrame([(s, parts.get(s, 1)) for s in range(slots)], "virtual_slot int, _parts int"))
    rows = rows.join(known, "virtual_slot").withColumn("part", F.pmod(F.xxhash64("_n"), F.col("_parts")).cast("int"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("virtual_slot", "part").agg(F.sum("size")).collect()}
    m = new_map(sizes, parts, slots, shards)
    rebalance(m, shards)
    stored = m.store(spark)
    latest = stored.where(F.col("version") == len(m.versions)).select("virtual_slot", "part", "shard")
    dealt = rows.join(F.broadcast(latest), ["virtual_slot", "part"])
    chunks = sorted_chunks(dealt.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "_n", F.lit(1).cast("long").alias("_one")), ["shard", "virtual_slot", "_n"], "shard-order")
    unstage(staged)
    placed = running_sums(chunks, "shard", "_one", "place")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "place"), stored
