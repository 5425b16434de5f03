"""Every stage of the pipeline against brute force on what its predecessor kept."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_first import TOKENIZER, brute_targets, size
from test_neardup import brute
from test_pii import plain

from strataforge.llm import quality
from strataforge.llm.common import stage


def test_stages(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, f in corpus_pipeline.STAGES:
        kept.append(docs.collect())
        docs = stage(f(spark, docs, sf), name.replace(" ", "-"))
        if name != "best-fit packing":
            assert docs.columns == columns
    start, good, single, masked, mixed, packed = *kept, docs.collect()

    scores = quality.score_quality(spark.createDataFrame(start), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in scores if r.score >= 0.5)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, q in truth.items() if q]
    assert len({r.doc_id for r in good} & set(clean)) >= 0.95 * len(clean)

    _, components = brute([(r.doc_id, r.text) for r in good], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted(i for i, c in components.items() if i == c)
    assert len(single) < len(good)

    before = {r.doc_id: r.text for r in single}
    assert {r.doc_id for r in masked} == set(before)
    for r in masked:
        assert not plain(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) or plain(before[r.doc_id]) or "<" in r.text

    sizes, taken, source = defaultdict(int), defaultdict(int), {r.doc_id: r for r in masked}
    for r in masked:
        sizes[r.source] += size(r.text)
    for r in mixed:
        taken[r.source] += size(r.text)
        assert source[r.doc_id].text.startswith(r.text)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.5

    model, want = Tokenizer.from_file(TOKENIZER), []
    for r in mixed:
        ids = [*model.encode(r.text, add_special_tokens=False).ids, 0]
        want += [(r.doc_id, i // 2048, i, ids[i : i + 2048]) for i in range(0, len(ids), 2048)]
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, list(r.ids)) for r in packed)
    bins = defaultdict(list)
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()] and sum(n for _, n in spans) <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_on_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.where("false")):
        for name, f in corpus_pipeline.STAGES:
            frame = stage(f(spark, frame, "/root/testdata/sf0.001"), name.replace(" ", "-"))
        frame.collect()
