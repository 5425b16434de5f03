"""Virtual slots: near equal bytes, gapless places, and maps that move no more than they must."""

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strataforge.llm import queries, shards


def held(docs, **options):
    placed, stored = shards.shard(docs, **options)
    rows = placed.collect()
    places, loads = defaultdict(list), defaultdict(int)
    for r in rows:
        places[r.shard].append(r.place)
        loads[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return rows, loads, stored


def test_rows_and_sizes(documents, odd, empty):
    for docs in (documents, odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        rows, loads, _ = held(docs)
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
        assert set(loads) <= set(range(40))
    assert held(empty)[0] == []


def test_near_equal_bytes(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pow(xxhash64(id) % 1000 / 1000.0, 4) * 3000 as int))").alias("text"))
    _, loads, stored = held(docs)
    mean = sum(loads.values()) / 40
    assert len(loads) == 40 and max(abs(n - mean) for n in loads.values()) <= 0.002 * mean
    assert {r.version for r in stored.collect()} == {1, 2}
    by_slot = stored.where("version = 2").groupBy("virtual_slot").agg(F.sum("bytes").alias("n")).collect()
    assert len(by_slot) == 4096 and sum(r.n for r in by_slot) == sum(loads.values())


def test_one_id_and_one_text_hold_half(spark):
    """Rows that share an id, a text or both are dealt over shards, and no row is lost."""
    docs = spark.range(20_000).select(F.expr("if(id % 2 = 0, 7, id)").alias("doc_id"), F.expr("if(id % 3 = 0, 'same', repeat('y', cast(id % 90 as int)))").alias("text"))
    rows, loads, _ = held(docs)
    mean = sum(loads.values()) / 40
    assert len(rows) == 20_000 and max(abs(n - mean) for n in loads.values()) <= 0.01 * mean


def test_a_slot_stays_whole_unless_heavy(documents):
    big = documents.select((F.col("doc_id") % 50).alias("doc_id"), F.lit("t").alias("text"))
    rows, _, _ = held(big, shards=4, grain=1)
    of = defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_growing_moves_only_into_the_new_shard(spark):
    rng = np.random.default_rng(2)
    m = shards.new_map({(i, 0): int(n) for i, n in enumerate(rng.pareto(1.2, 4096).clip(0, 40) * 1000)}, {}, 4096, 40)
    shards.rebalance(m, 40)
    before = m.shards.copy()
    shards.grow(m, 40)
    moved = m.shards != before
    assert (m.shards[moved] == 40).all() and moved.any()
    loads = m.loads(41)
    assert abs(loads[40] - m.bytes.sum() / 41) <= 0.01 * m.bytes.sum() / 41
    shards.rebalance(m, 41)
    assert np.ptp(m.loads(41)) <= 0.002 * m.bytes.sum() / 41
    again = shards.read_map(m.store(spark))
    assert len(again.versions) == 4 and all((a == b).all() for a, b in zip(m.versions, again.versions))
    assert (again.bytes == m.bytes).all()


def test_rebalancing_moves_few(spark):
    m = shards.new_map({(i, 0): 100 + i % 7 for i in range(4096)}, {}, 4096, 40)
    shards.rebalance(m, 40)
    assert (m.versions[0] != m.versions[1]).sum() < 410


def test_query(spark):
    rows = queries.op12_virtual_slots(spark, "/root/testdata/sf0.001").collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and len(rows) == 200
