"""Whitening, quality scores and ranked search against plain forms, and on hand-made edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beatwatch.llm import queries, search, whitening
from beatwatch.llm import quality_net as quality

SF = "/root/testdata/sf0.001"
EXTRA = ("rank", "score", "component", "label", "item", "part", "odds", "shard", "n", "term", "x", "predicted")


def with_extra(df):
    return df.withColumns({c: F.lit(7) for c in EXTRA})


# ---- whitening


def vectors(spark, rows):
    return with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))


def plain_whitening(rows, components=4):
    """Exact sums and deviations, eigenpairs by a dense solver."""
    ok = lambda v: v is not None and all(e is not None and math.isfinite(e) for e in v)
    kept = [(i, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v in rows if ok(v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (dims - len(x))) for i, x in kept]
    distinct = sorted({tuple(x) for _, x in kept})
    n, total = len(distinct), [sum(c) for c in zip(*distinct)]
    mean = np.array([float(Fraction(s, n)) for s in total])
    centred = np.array(distinct, float) - mean
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > dims * np.finfo(float).eps * np.trace(cov)).sum()))
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, total)) for _, x in kept]
    z = (np.array([x for _, x in kept], float) - mean) @ v[:, :k] / np.sqrt(e[:k])
    return n, [i for i, _ in kept], dev, z, e[:k] / np.trace(cov)


def assert_whitened(got, rows, within=1e-9):
    n, ids, dev, z, explained = plain_whitening(rows)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c + 1) for i in ids for c in range(z.shape[1]))
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == Counter(zip(ids, dev))
    for c in range(z.shape[1]):
        mine = np.array([by[i, c + 1][0]["whitened"] for i in ids])
        sign = np.sign(mine @ z[:, c])
        assert np.abs(sign * mine - z[:, c]).max() < within
        assert abs(by[ids[0], c + 1][0]["explained"] / explained[c] - 1) < 1e-9
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_whitening_of_the_given_vectors(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert_whitened(queries.op12_jacobi_davidson_whitening(spark, SF).collect(), rows)


def test_whitening_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (None, rows[2][1])]  # copies count once in the fit
    assert len(queries.whitening.whiten(vectors(spark, rows), whitening.fit(vectors(spark, rows))).filter("vec_id is null").collect()) == 8
    named = [(i if i is not None else -1 - j, v) for j, (i, v) in enumerate(rows)]
    named += [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [0.25, -0.0])]
    df = vectors(spark, named)
    found = whitening.fit(df)
    assert_whitened(whitening.whiten(df, found).collect(), named)
    again = whitening.fit(df.repartition(7))
    assert (again.n, again.sums) == (found.n, found.sums) and np.abs(np.abs(again.vectors) - np.abs(found.vectors)).max() < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [3.0, 4.0])], [(1, [3.0, 4.0]), (2, [3.0, 4.0])]])
def test_whitening_without_variance(spark, rows):
    df = vectors(spark, rows)
    assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_whitening_of_few_dimensions_and_huge_entries(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    df = vectors(spark, line)
    assert_whitened(whitening.whiten(df, whitening.fit(df)).collect(), line)
    wide = [(i, [float(i) * 1e12, float(i % 3) * 1e9]) for i in range(9)]
    df = vectors(spark, wide)
    assert_whitened(whitening.whiten(df, whitening.fit(df)).collect(), wide)
    kept, x, first = whitening.whole_numbers(pa.array([[3e38, -3e38]], pa.list_(pa.float32())))
    assert x.tolist() == [2**63 - 1, -(2**63)]


def test_packed_vectors():
    draw = np.random.default_rng(1)
    lists = [[], [0], [5, 0, 0], [-1, 127, -128], [128], [-40000, 3], [2**62, -(2**63)], [0, 0, -7]]
    lists += [draw.integers(-(2 ** int(b)), 2 ** int(b), 9).tolist() for b in draw.integers(1, 62, 40)]
    x = np.array([v for r in lists for v in r], np.int64)
    first = np.concatenate(([0], np.cumsum([len(r) for r in lists])))
    got, at = whitening.unpack(whitening.pack(x, first))
    for i, r in enumerate(lists):
        while r and r[-1] == 0:
            r = r[:-1]
        assert got[at[i] : at[i + 1]].tolist() == r


@pytest.mark.parametrize("dims,twins", [(1, 1), (3, 1), (40, 1), (90, 1), (70, 3)])
def test_leading_pairs(dims, twins):
    draw = np.random.default_rng(dims)
    basis = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
    values = np.sort(draw.uniform(1, 2, dims))[::-1]
    values[:twins] = values[0]
    cov = (basis * values) @ basis.T
    cov = (cov + cov.T) / 2
    asked = []
    e, v = whitening.leading_pairs(lambda y: asked.append(y.shape[1]) or cov @ y, dims)
    k = min(4, dims)
    assert np.abs(e - values[:k]).max() < 1e-13
    assert np.linalg.norm(cov @ v - v * e, axis=0).max() < 1e-13 and np.abs(v.T @ v - np.eye(k)).max() < 1e-13
    assert max(asked) <= max(whitening.Settings().start, 12)


def test_minres():
    draw = np.random.default_rng(2)
    a = draw.normal(size=(30, 30))
    a = a + a.T
    right = draw.normal(size=(30, 3))
    assert np.abs(a @ whitening.minres(lambda y: a @ y, right, 60, 1e-12) - right).max() < 1e-8


# ---- ranked search


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, top=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, every = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * total) // every
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda r: r[:3])
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(scored[:top], 1)]
    return out


def same_ranks(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks, shards and first documents so small that every path is taken."""
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FIRST", 3)


def some_texts(n, seed):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x-y", "A.B", "3d"]
    odds = 1 / np.arange(1, len(words) + 1)
    return [" ".join(draw.choice(words, int(draw.integers(0, 60)), p=odds / odds.sum())) for _ in range(n)]


def in_shards(texts, ids, total, per):
    """Shards of ``per`` documents, as a task makes and reads them."""
    out = []
    for a in range(0, len(texts), per):
        column = pa.array(texts[a : a + per], pa.string())
        parts = list(search.chunks(column, 1 << 30))
        words = search.find_words(parts[0][2], parts[0][3], search._IN_TERM)
        out.append(search.Shard(search.build_shard(a, pa.array(ids[a : a + per], pa.int64()), words, total).to_pylist()[0]))
    return out


@pytest.mark.parametrize("per", [5, 40, 300])
def test_ranks_in_shards(small_blocks, per):
    texts = some_texts(300, 4)
    ids = [int(i) for i in np.random.default_rng(5).integers(0, 250, 300)]
    items = [(i, t) for i, t in enumerate(some_texts(40, 6))]
    counts = [len(plain_terms(t)) for t in texts]
    total = search.Totals(sum(c > 0 for c in counts), sum(counts))
    shards = in_shards(texts, ids, total, per)
    df = Counter(t for text in texts for t in set(plain_terms(text)))
    got, opened = [], 0
    for item, text in items:
        ranking = search.Ranking.new(10)
        terms = sorted(set(plain_terms(text)) & df.keys())
        for shard in shards:
            codes = {t.decode(): i for i, t in enumerate(shard.terms.to_pylist())}
            has = [t for t in terms if t in codes]
            if has:
                search.rank_in_shard(shard, np.array([codes[t] for t in has]), np.array([total.weight(df[t]) for t in has]), ranking)
        got += [(item, i + 1, int(d), int(s)) for i, (d, s) in enumerate(zip(ranking.ids, ranking.score))]
    same_ranks(got, plain_search(list(zip(ids, texts)), items))


def test_blocks_are_rejected_packed():
    """A list of many blocks whose documents are far below the best stays packed for the most part."""
    texts = ["rare common"] * 12 + ["common " + "filler " * (i % 50 + 5) for i in range(20_000)]
    total = search.Totals(len(texts), sum(len(t.split()) for t in texts))
    (shard,) = in_shards(texts, list(range(len(texts))), total, len(texts))
    code = {t.decode(): i for i, t in enumerate(shard.terms.to_pylist())}
    ranking = search.Ranking.new(10)
    search.rank_in_shard(shard, np.array([code["rare"], code["common"]]), np.array([total.weight(12), 30]), ranking)
    assert ranking.ids.tolist() == list(range(10))
    a, b = shard.first[code["common"]], shard.first[code["common"] + 1]
    assert b - a > 150 and (~shard.packed[a:b]).sum() == 1


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 6)
    docs = [(1, None), (2, ""), (3, " ,;"), (4, "Alpha beta, GAMMA-delta"), (5, "alpha beta"), (5, "alpha beta"), (None, "alpha beta"), (6, "é É ß")]
    docs += [(7, "long " * 200_000 + "tail"), (8, "x" * 70_000), (9, "al\x00pha [beta] ~gamma~")]
    items = [(1, "ALPHA beta alpha"), (2, None), (3, ""), (4, "unknown words"), (5, "é tail"), (6, "gamma"), (6, "delta"), (None, "beta"), (None, "x" * 70_000), (7, "long")]
    d = with_extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    i = with_extra(spark.createDataFrame(items, "item_id long, text string").repartition(2))
    want = plain_search(docs, [r for r in items])
    got = search.ranked_search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same_ranks(got.collect(), want)
    same_ranks(search.ranked_search(d, i, top=2).collect(), plain_search(docs, items, 2))
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("doc_id < 4"), i)):
        none = search.ranked_search(a, b)
        assert none.collect() == [] and none.columns == got.columns


# ---- quality


def plain_odds(net, raw, s):
    """One text's mean log-odds by loops over chunks, windows and filters, in doubles."""
    starts, step = [0], s.chunk - s.overlap
    while starts[-1] + s.chunk < len(raw):
        starts.append(min(starts[-1] + step, len(raw) - s.chunk))
    found = []
    for a in starts:
        chunk = raw[a : a + s.chunk].ljust(s.chunk, b"\0")
        tops = []
        for f in range(s.filters):
            answers = []
            for t in range(0, s.chunk - s.width + 1, s.stride):
                answers.append(sum(float(net.embed[chunk[t + w], e]) * float(net.filters[w * s.embed + e, f]) for w in range(s.width) for e in range(s.embed)))
            tops.append(max(0.0, max(answers) + float(net.filter_bias[f])))
        held = [math.tanh(sum(p * float(net.layer[f, h]) for f, p in enumerate(tops)) + float(net.layer_bias[h])) for h in range(s.hidden)]
        found.append(sum(x * float(o) for x, o in zip(held, net.out)) + float(net.out_bias[0]))
    return sum(found) / len(found)


SMALL = quality.Settings(chunk=32, overlap=8, width=5, stride=2, embed=3, filters=4, hidden=3)


def test_quality_forward_pass():
    net = quality.Network.new(SMALL)
    draw = np.random.default_rng(1)
    raws = [b"", b"a", b"x" * 32, b"y" * 33, bytes(draw.integers(0, 256, 200, dtype=np.uint8)), bytes(draw.integers(0, 256, 56, dtype=np.uint8))]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    got = quality.text_odds(net, np.frombuffer(b"".join(raws), np.uint8), offsets, SMALL)
    assert np.abs(got - [plain_odds(net, r, SMALL) for r in raws]).max() < 1e-4


def test_quality_gradients():
    net = quality.Network.new(SMALL)
    for name in ("embed", "filters", "filter_bias", "layer", "layer_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float) + 0.01)
    draw = np.random.default_rng(2)
    text = draw.integers(0, 256, (6, SMALL.chunk)).astype(np.uint8)
    label, weight = draw.integers(0, 2, 6).astype(float), draw.uniform(0.5, 2, 6)
    _, grads = quality.gradients(net, text, label, weight, SMALL.stride)
    for w, g in zip(net.weights(), grads):
        for at in draw.integers(0, w.size, 12):
            step, was = 1e-6, w.flat[at]
            w.flat[at] = was + step
            up = quality.gradients(net, text, label, weight, SMALL.stride)[0]
            w.flat[at] = was - step
            down = quality.gradients(net, text, label, weight, SMALL.stride)[0]
            w.flat[at] = was
            assert abs((up - down) / (2 * step) - g.flat[at]) < 1e-4


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op11_byte_cnn_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert got.keys() == {r[0] for r in docs}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if d in got and got[d]["held_out"]]
    good = [got[d]["score"] for d in held if labels[d] == 1]
    bad = [got[d]["score"] for d in held if labels[d] == 0]
    assert np.mean([got[d]["predicted"] == labels[d] for d in held]) > 0.9
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95


def test_quality_edges(spark):
    texts = [None, "", "word " * 60_000, "ß é 日本\n" * 40, "### $$$ %%% &&& " * 30, "a plain line of words, and one more. " * 20]
    rows = [(i, texts[i % 6]) for i in range(48)] + [(None, "x"), (3, "again"), (3, "again")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i % 6 != 4)) for i in range(36)] + [(None, 0), (5, None), (5, 9), (999, 0)], "doc_id long, label int")
    small = quality.Settings(epochs=2, steps=120, per_label=50)
    net = quality.fit(docs, labels, small)
    got = quality.score(docs, net, small)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(d for d, _ in rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[40]["predicted"] == 0 and by[41]["predicted"] == 1 and 0 <= by[36]["score"] <= 1 and by[36]["score"] == by[37]["score"]
    again = quality.fit(docs.repartition(5), labels.repartition(2), small)
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights()))
    assert quality.score(docs.limit(0), net, small).collect() == []
    assert quality.fit(docs, labels.limit(0), small) is None and quality.fit(docs.limit(0), labels, small) is None
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, None, small).collect()} == {(0.5, 0)}
    one = quality.fit(docs, labels.filter("label = 1"), small)
    assert quality.score(docs, one, small).filter("predicted = 1").count() > 40
