"""The pipeline's stages, each and in a row, against their plain forms."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import brute

from beatwatch.llm import queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    table = queries.documents(spark, SF)
    docs = {r["doc_id"]: r for r in table.collect()}
    benchmark = [tuple(r) for r in queries.benchmark(spark, SF).select("item_id", "text").collect()]
    frames = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_records"]

    left = {d: r["text"] for d, r in docs.items() if brute.quality(r["text"])["kept"]}
    stage = frames["quality_rules"](spark, table, SF)
    assert stage.columns == table.columns and {r["doc_id"] for r in stage.select("doc_id").collect()} == left.keys() < docs.keys()

    groups = brute.components(list(left.items()), percent=80)
    left = {d: t for d, t in left.items() if groups[d][1] == d}
    bad = brute.contaminated(list(left.items()), benchmark)
    left = {d: t for d, t in left.items() if not bad[d]}
    copies, _ = brute.mix([(d, t, docs[d]["source"]) for d, t in left.items()])

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    rows = [(d, t) for d, t in left.items() for _ in range(copies[d])]
    want = brute.token_records(rows, lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in want)
    assert Counter(r["doc_id"] for r in got) == Counter({d: n for d, n in copies.items() if n})
