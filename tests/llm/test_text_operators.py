"""Each operator against its plain form, on the given documents and on hand-made edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
import brute

from beatwatch.llm import blocks, language, minhash, mixing, pii, queries, recompression, records, repetition, sharding, suffix_tree, tiling, words

SF = "/root/testdata/sf0.001"
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
TEXTS = [
    None,
    "",
    " \n\t ",
    "alone",
    "Mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567; token = \"ab12cd34\"",
    COPY,
    COPY,
    COPY.upper(),
    COPY + " " + COPY,
    "x" * 70_000 + " word",
    "long " * 30_000 + "tail",
    "é ß 日本 ñ\n" * 8,
]
# columns that clash with names the operators use inside
EXTRA = ("size", "kept", "block", "copies", "target", "key", "label", "id", "row", "shard", "spans", "bands", "seeds", "n_words")


@pytest.fixture(scope="module")
def docs(spark):
    return queries.documents(spark, SF).select("doc_id", "text", "lang", "source").persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Every edge text under its own id, a null id, and a row that stands there three times."""
    data = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 2}") for i, t in enumerate(TEXTS)]
    data += [(None, COPY, "en", "s0"), (50, "again and again", None, None), (50, "again and again", None, None), (50, "again and again", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in EXTRA}).persist()


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


# Scores -------------------------------------------------------------------------------------


def test_suffix_tree_scores(docs, rows):
    s = suffix_tree.Settings()
    want = brute.suffix_scores([r[:2] for r in rows], s.depth, s.least, s.gain, s.pull)
    got = by_id(suffix_tree.score_texts(docs))
    assert got.keys() == want.keys()
    for d, (held, n, known, train, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert close(r["base_score"], base) and math.isclose(r["score"], score, rel_tol=1e-4)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_suffix_tree_depth(spark):
    """Only contexts of six words tell which of two words ends a passage; each depth agrees with the plain form."""
    rng = random.Random(5)
    texts = []
    for i in range(240):
        noise = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 12)))
        texts.append((i, f"{noise} {('this', 'that')[i % 2]} page was last changed on {('monday', 'sunday')[i % 2]} {noise}"))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    totals = []
    for depth in (0, 1, 4, 6):
        s = suffix_tree.Settings(depth=depth, pull=(20.0, 5.0, 2.0))
        want = brute.suffix_scores(texts, depth, s.least, s.gain, s.pull)
        got = by_id(suffix_tree.score_texts(df, s))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[d]["score"], w[5], rel_tol=1e-5) for d, w in want.items())
        totals.append(sum(r["score"] for r in got.values() if r["held_out"]))
    assert totals == sorted(totals) and totals[3] - totals[2] > 5


def test_keys_go_to_the_buckets_that_hold_them():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    for buckets in (1, 7, 1 << 20):
        places = blocks.split(keys, buckets)
        assert all(len(at) and 0 <= b < buckets for b, at in places) and len(places) <= len(keys)
        assert np.array_equal(np.sort(np.concatenate([at for _, at in places])), np.arange(len(keys)))
    assert blocks.split(keys[:0], 9) == []


@pytest.mark.parametrize("high", [3, 1 << 12, (1 << 64) - 1])
def test_distinct_hashes(high):
    """Also where many different keys have the same upper bits."""
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 1000):
        keys = rng.integers(0, high, size, np.uint64, endpoint=True)
        held, place = words.distinct(keys)
        assert np.array_equal(held, np.unique(keys)) and np.array_equal(held[place], keys)
    starts = np.array([5, 0, 90])
    assert np.array_equal(words.gram_hashes_at(keys, starts, 7), words.gram_hashes(keys, 7)[starts])
    rolled = words.Rolled(np.concatenate([keys, keys]))
    for n in (1, 2, 5, 40, len(keys)):
        grams = rolled.grams(n)
        # equal runs at other places, and nothing else, have equal hashes
        assert len(grams) == 2 * len(keys) - n + 1
        assert np.array_equal(grams[: len(keys) - n + 1], grams[len(keys) :])
        assert len(np.unique(grams)) == len({tuple(np.concatenate([keys, keys])[k : k + n].tolist()) for k in range(len(grams))})
        assert np.array_equal(rolled.grams(n, starts), grams[starts])
    assert not len(words.Rolled(keys[:0]).grams(1)) and not len(words.Rolled(keys[:3]).grams(4))


def test_suffix_tree_edges(edge, empty):
    got = suffix_tree.score_texts(edge).collect()
    assert len(got) == edge.count()
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    assert sum(r["doc_id"] is None for r in got) == 1
    assert suffix_tree.score_texts(empty).count() == 0


# Near-duplicates ----------------------------------------------------------------------------


def test_near_duplicates(docs, rows):
    want = brute.components([r[:2] for r in rows])
    got = by_id(minhash.near_duplicates(docs))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert len(set(c for _, c in want.values())) < len(want)


def test_chains_of_near_copies(spark):
    """Copies of copies: neighbours are linked, the ends are not; groups stay whole and apart."""
    draw = random.Random(4)
    data, n = [], 0
    for group in range(4):
        text = [f"g{group}w{i}" for i in range(120)]
        for _ in range(60):
            data.append((n, " ".join(text)))
            n += 1
            at = draw.randrange(120)
            text[at] = f"edit{n}" if draw.random() < 0.6 else text[at]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.components(data)


def test_buckets_of_many_labels_are_compared_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    bits = ", ".join(f"s{i} long" for i in range(4))
    for sizes in ([5] + [1] * 80, [40] + [1] * 30):
        label = [n for n, size in enumerate(sizes) for _ in range(size)]
        members = spark.createDataFrame([(1, x, i, 9, 0, 0, 0, 0, 0) for i, x in enumerate(label)], f"key long, label long, id long, n_shingles long, private long, {bits}")
        vals = members.selectExpr("id", "binary('') vals")
        groups = {}
        for r in minhash.tile_rows(members, vals).collect():
            groups.setdefault((r["t"], r["u"]), []).append((r["id"], r["own"]))
        assert max(map(len, groups.values())) <= 40
        met = set()
        for (t, u), rows in groups.items():
            first, second = ([i for i, own in rows if own >= 0], [i for i, own in rows if own < 0]) if t < 0 else ([i for i, own in rows if own == t], [i for i, own in rows if own == u])
            met |= {frozenset((i, j)) for i in first for j in second}
        assert all(frozenset((i, j)) in met for i in range(len(label)) for j in range(i) if label[i] != label[j])
    # a template whose texts share bands and stay below the threshold, with a few linked copies among them
    draw, data = random.Random(6), []
    for n in range(120):
        text = [f"w{i}" for i in range(200)]
        for at in range(15, 195, 20):
            text[at] = f"fill{draw.randrange(5)}"
        data.append((n, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.components(data) and 16 < len({c for _, c in got.values()}) < len(data)


def test_pipeline_stage_links_at_80_percent(spark, docs, rows):
    import corpus_pipeline

    want = brute.components([r[:2] for r in rows], 80)
    assert want != brute.components([r[:2] for r in rows], 85)
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {d for d, (_, c) in want.items() if c == d}


def test_least_estimate_is_six_deviations_below_the_threshold():
    for percent in range(80, 101):
        share = 0.25 + 0.75 * percent / 100
        most = percent / 100 - 6 * math.sqrt(share * (1 - share) / minhash.MINIMA) / 0.75
        assert most - 0.011 < minhash.least_estimate(percent) <= most + 1e-9
    assert (minhash.least_estimate(80), minhash.least_estimate(85)) == (0.54, 0.62)


def test_texts_of_one_doc_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(7, a), (3, a + " end"), (7, b), (9, b), (9, c), (1, c + " end"), (5, "alone here with five words"), (5, "and once more with others")]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 8 and {(r["doc_id"], r["component_id"]) for r in got} == {(7, 1), (3, 1), (9, 1), (1, 1), (5, 5)}


def test_near_duplicates_edges(edge, empty):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    found = {r["doc_id"]: r for r in got}
    assert [found[d]["component_id"] for d in (0, 1, 2)] == [0, 1, 2] and found[0]["n_shingles"] == 0
    assert [found[d]["component_id"] for d in (5, 6, 7, 8)] == [5, 5, 5, 8 if found[8]["component_id"] == 8 else 5]
    assert found[None]["kept"] and sum(r["doc_id"] == 50 and r["component_id"] == 50 for r in got) == 3
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.without_duplicates(edge)
    assert left.columns == edge.columns
    # a null id does not save a copy, and an id that stands with other texts does not lose them
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect() if r["doc_id"] in (5, 6, 7, 50, None)) == [5, 50]


def test_rows_are_judged_by_their_own_text(spark):
    other = " ".join(f"w{i}" for i in range(40))
    near = other.replace("w39", "end")
    rows = [(None, COPY), (None, COPY), (3, COPY), (7, other), (7, "quite another text of more than five words"), (9, near), (None, other), (None, None), (None, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, source string, _row long, _row_ long").repartition(3)
    left = minhash.without_duplicates(docs)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert got == Counter([(3, COPY), (7, other), (7, "quite another text of more than five words"), (None, None), (None, ""), (8, None)])
    items = spark.createDataFrame([(1, other)], "item_id long, text string")
    clean = tiling.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(r for r in rows if r[1] not in (other, near))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {(*r, "s", 1, 2) for r in rows}


def test_estimate_is_corrected_for_chance(spark):
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.0, 0.5, 0.9, 1.0):
        cut = int(4000 * share)
        b = np.concatenate([a[:cut], draw.integers(0, 1 << 63, 4000 - cut).astype(np.uint64)])
        minima = []
        for s in (a, b):
            low = (s >> np.uint64(32)).astype(np.uint32)
            minima.append([(low * x + y).min() for x, y in zip(minhash._A, minhash._B)])
        planes = minhash.pack_planes(np.array(minima, np.uint32)).tolist()
        row = spark.createDataFrame([(*planes[0], *planes[1])], ", ".join([f"x{i} long" for i in range(4)] + [f"y{i} long" for i in range(4)]))
        assert abs(row.select(minhash.estimate("x", "y")).first()[0] - cut / (8000 - cut)) < 0.2


# Mixing -------------------------------------------------------------------------------------


def test_mix(docs, rows):
    copies, sources = brute.mix([(d, t, s) for d, t, _, s in rows])
    got = by_id(mixing.mix(docs))
    assert {d: r["copies"] for d, r in got.items()} == copies
    for r in got.values():
        size, target = sources[r["source"]]
        assert r["source_size"] == size and close(r["target"], target) and r["copies"] <= 2
    assert close(sum(t for _, t in sources.values()), 1.5 * sum(n for n, _ in sources.values()))
    again = by_id(mixing.mix(docs.repartition(7)))
    assert {d: r["copies"] for d, r in again.items()} == copies


def test_mixed_documents(docs, rows):
    copies, _ = brute.mix([(d, t, s) for d, t, _, s in rows])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(tuple(r) for r in mixed.collect()) == Counter({r: copies[r[0]] for r in rows if copies[r[0]]})


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count() and all(0 <= r["copies"] <= 2 for r in got)
    for source in (None, "s0", "s1"):
        part = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in part) - part[0]["target"]) <= 2 * max(r["size"] for r in part)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns


def test_prefix_sums_meet_at_range_ends(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 50)
    data = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()} == brute.mix(data)[0]


# Personal data ------------------------------------------------------------------------------


def test_spans_are_those_of_the_patterns():
    draw = random.Random(3)
    pieces = ["1", "2", "12", "255", "0", "00", ".", ".", "-", " ", "+", "@", "a", "b.c", "é", "x@y.z", "+1 555 123 4567", "4785380592391139"]
    pieces += ["(", ")", "%", "\n", "_", 'token = "', "4111 1111 1111 1111", "٣", "http://", "IBAN "]
    for _ in range(5000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 30)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute.personal_data(text), text


def test_further_kinds():
    text = "see https://example.org/a?b=1. Account number: AB-123456, IBAN GB82 WEST 1234 5698 7654 32 and account: none"
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)] == [
        ("url", "https://example.org/a?b=1"),
        ("account", "AB-123456"),
        ("account", "GB82 WEST 1234 5698 7654 32"),
    ]
    assert pii.redacted("a@b.co x", [("email", 0, 6)]) == "[EMAIL] x"


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"password": "hunter22x"}', ["hunter22x"]),
        ("account number 12345678", ["12345678"]),
        ("Account No. 1234-5678, then", ["1234-5678"]),
        ("apiKey=ab12cd34", ["ab12cd34"]),
        ("User_ID: qwe123x", ["qwe123x"]),
        ("é TOKEN=ab12cd34", ["ab12cd34"]),
        ("account number 12345678x", []),
        ("account 1234", []),
        ("secretary 123456", []),
        ("IBAN ES91 2100 0418 4502 0005 1332 IN EURO", ["ES91 2100 0418 4502 0005 1332"]),
        ('"iban":"AT611904300234573201"', ["AT611904300234573201"]),
        ("Iban NO93 8601 1117 947", ["NO93 8601 1117 947"]),
        ("IBAN ES91 2100 0418 4502 0005 1333", []),
        ("IBAN AT6119043002345732011", []),
        ("IBAN ZZ61 1904 3002 3457 3201", []),
    ],
)
def test_cues_in_any_spelling(text, want):
    assert [text[a:b] for kind, a, b in pii.find_spans(text) if kind == "account"] == want


def test_personal_data(docs, rows, edge, empty, spark):
    got = by_id(queries.op4_anchor_pii(spark, SF))
    for d, text, *_ in rows:
        base = brute.personal_data(text)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(k == x for x, *_ in base) for k in pii.BASE_KINDS]
    found = pii.personal_data(edge, redact=True).collect()
    assert len(found) == edge.count()
    one = next(r for r in found if r["doc_id"] == 4)
    assert [s["kind"] for s in one["spans"]] == ["email", "ip", "card", "phone", "account"] and "[CARD]" in one["text"]
    assert next(r for r in found if r["doc_id"] == 0)["text"] is None
    assert pii.personal_data(empty).count() == 0


# Quality ------------------------------------------------------------------------------------


def test_quality(docs, rows, edge, empty):
    got = by_id(repetition.quality(docs))
    for d, text, *_ in rows:
        assert {k: got[d][k] for k in brute.quality(text)} == brute.quality(text)
    for df in (edge, empty):
        found = repetition.quality(df).collect()
        assert len(found) == df.count()
    for r in repetition.quality(edge).collect():
        if r["doc_id"] is not None and r["doc_id"] < len(TEXTS):
            want = brute.quality(TEXTS[r["doc_id"]])
            assert {k: r[k] for k in want} == want
    kept = repetition.keep_good(edge)
    assert kept.columns == edge.columns and {5, 6} <= {r["doc_id"] for r in kept.collect()}
    assert not {0, 1, 2, 3, 10} & {r["doc_id"] for r in kept.collect()}


# Repeated passages --------------------------------------------------------------------------


def test_remove_repeats(docs, rows):
    want = brute.without_repeats([r[:2] for r in rows])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in recompression.remove_repeats(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0


def test_remove_repeats_with_runs_and_few_words(spark, monkeypatch):
    """Few kinds of words make runs, periods and repeats of every length; small blocks and buckets cut them often."""
    monkeypatch.setattr(recompression.B, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(recompression.B.counts, "__defaults__", (2000,))
    monkeypatch.setattr(recompression.B.write_blocks, "__defaults__", (1500, None))
    draw = random.Random(8)
    data = []
    for d in range(120):
        parts = []
        for _ in range(draw.randint(0, 8)):
            kind = draw.random()
            if kind < 0.3:
                parts += [draw.choice("ab")] * draw.randint(1, 60)
            elif kind < 0.6:
                parts += [draw.choice("ab"), draw.choice("cd")] * draw.randint(1, 40)
            else:
                parts += [draw.choice("abcd") for _ in range(draw.randint(1, 40))]
        data.append((d, " ".join(parts)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in recompression.remove_repeats(df).collect()}
    assert got == brute.without_repeats(data)


def test_symbols_inside_equal_windows_are_equal():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 50, 400).astype(np.uint64)
    b = draw.integers(0, 50, 400).astype(np.uint64)
    b[100:160] = a[200:260]
    doc = np.repeat([0, 1], 400)
    symbols, low, high = recompression.parse(np.concatenate([a, b]), doc)
    one = {(int(l) - 200, int(s)) for s, l, h in zip(symbols, low, high) if 200 <= l and h <= 260}
    two = {(int(l) - 500, int(s)) for s, l, h in zip(symbols, low, high) if 500 <= l and h <= 560}
    assert one == two and len(one) >= 5


def test_remove_repeats_edges(edge, empty):
    got = recompression.remove_repeats(edge).collect()
    assert len(got) == edge.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in edge.collect())
    found = {r["doc_id"]: r for r in got}
    assert found[None]["n_removed"] == 0 and found[None]["kept_text"] == COPY  # no id comes before all ids
    assert found[0]["kept_text"] == "" and found[5]["kept_text"] == "" and found[5]["n_removed"] == 21
    assert found[7]["n_removed"] == 0 and found[10]["n_removed"] > 29_000
    assert recompression.remove_repeats(empty).count() == 0


# Language -----------------------------------------------------------------------------------


def test_every_language_is_learned(spark):
    """Seventy labels, each with letters of its own."""
    alphabet = [chr(0x4E00 + 40 * i) for i in range(70)]
    rows = [(100 * i + j, (a + " ") * 30, f"l{i:02d}") for i, a in enumerate(alphabet) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = language.Settings(hidden=16, steps=400)
    net = language.fit(docs, small)
    assert net.names == [f"l{i:02d}" for i in range(70)]
    got = language.predict(docs, net, small).join(docs, "doc_id").filter("lang = lang_pred").count()
    assert got > 0.8 * len(rows)


def test_forward_pass_by_loops():
    """States, labels and pooled probabilities of one text by plain loops in doubles."""
    net = language.Network.new(["a", "b", "c"], 3, 5)
    net.bias = [b + np.float32(0.2) for b in net.bias]
    text, length = "Zwei Wörter, 12 und mehr.", 8
    raw = text.encode().lower()
    sums, letters = np.zeros(3), 0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for a in range(0, len(raw), length):
        piece = raw[a : a + length].ljust(length)
        states = []
        for side in (0, 1):
            state, found = [0.0] * 3, [None] * length
            for t in range(length) if side == 0 else range(length - 1, -1, -1):
                x = [float(v) for v in net.table[side][:, piece[t]]]
                u = [sum(float(w) * s for w, s in zip(row, state)) for row in net.turn[side]]
                update, reset = ([sigmoid(x[g + h] + u[g + h]) for h in range(3)] for g in (0, 3))
                new = [math.tanh(x[6 + h] + reset[h] * (u[6 + h] + float(net.bias[side][h, 0]))) for h in range(3)]
                state = [update[h] * state[h] + (1 - update[h]) * new[h] for h in range(3)]
                found[t] = state
            states.append(found)
        for t in range(length):
            both = states[0][t] + states[1][t]
            odds = [math.exp(sum(float(w) * s for w, s in zip(net.out[k], both)) + float(net.out_bias[k, 0])) for k in range(3)]
            if chr(piece[t]).isalpha() or piece[t] >= 0x80:
                sums += np.array(odds) / sum(odds)
                letters += 1
    data = np.frombuffer(text.encode(), np.uint8)
    got = language.pooled(net, data, np.array([0, len(data)]), length)[0]
    assert np.abs(got - sums / letters).max() < 1e-5


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    net = language.Network.new(["a", "b", "c"], 4, 1)
    net.bias = [b + np.float32(0.1) for b in net.bias]
    text = draw.integers(0, 256, (9, 5)).astype(np.uint8)
    lang, mask = draw.integers(0, 3, 5), (draw.random((9, 5)) < 0.7).astype(np.float32)
    _, grads = language.gradients(net, text, lang, mask)
    for i, w in enumerate(net.weights()):
        at = (0, int(text[4, 2])) if i < 2 else (0,) * w.ndim
        step = []
        for e in (0.02, -0.04):
            w[at] += np.float32(e)
            step.append(language.gradients(net, text, lang, mask)[0])
        w[at] += np.float32(0.02)
        assert abs((step[0] - step[1]) / 0.04 - grads[i][at]) < 2e-3


def test_language_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    lang = by_id(queries.documents(spark, sf).select("doc_id", "lang"))
    got = queries.op7_byte_gru_language(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]]["lang"] for r in out) >= 0.95 * len(out)


def test_language_edges(edge, empty, spark):
    net = language.fit(edge.select("doc_id", "text", "lang"), language.Settings(steps=40))
    got = language.predict(edge, net).collect()
    assert len(got) == edge.count()
    found = {r["doc_id"]: r for r in got}
    assert {found[d]["lang_pred"] for d in (0, 1, 2)} == {"und"} and found[5]["lang_pred"] == "en"
    assert language.fit(empty.select("doc_id", "text", "lang")) is None
    assert {r["lang_pred"] for r in language.predict(edge, None).collect()} == {"und"}
    assert language.predict(empty, net).count() == 0


# Sharding -----------------------------------------------------------------------------------


def winner(key, weights):
    def draw(shard, w):
        h = xxhash.xxh64(np.int32(shard).tobytes(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
        return math.log(((h >> 11) + 0.5) / 2**53) / w

    return max(((draw(s, w), -s) for s, w in enumerate(weights) if w > 0))[1] * -1


def test_rendezvous(docs, rows, spark):
    got = queries.op8_rendezvous_shards(spark, SF).collect()
    text = {d: t for d, t, *_ in rows}
    slots = Counter()
    for r in got:
        body = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
        assert r["shard"] == winner(str(r["doc_id"]), [1.0] * 24) and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"], r["slot"]] += 1
    assert set(slots.values()) == {1}
    assert all((s, n - 1) in slots for (s, n) in slots if n)


def test_shares_follow_weights(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 500)
    df = spark.range(8000).select(F.col("id").alias("doc_id"))
    got = sharding.shard_rows(df, "doc_id", [1.0, 2.0, 0.0, 1.0], grown=[1.0, 2.0, 0.0, 1.0, 2.0]).collect()
    share = Counter(r["shard"] for r in got)
    assert share[2] == 0 and abs(share[1] - 4000) < 250 and abs(share[0] - 2000) < 200
    assert sorted(r["slot"] for r in got if r["shard"] == 1) == list(range(share[1]))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {4}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


def test_sharding_edges(edge, empty):
    got = sharding.shard_rows(edge, "doc_id", [1.0] * 3, payload=[F.lit(1).alias("one")]).collect()
    assert len(got) == edge.count() and len({r["shard"] for r in got if r["doc_id"] == 50}) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert sharding.shard_rows(empty, "doc_id", [1.0] * 3).count() == 0


# Token records ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(encode):
    import pyarrow as pa

    from beatwatch.llm.words import text_bytes

    draw = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "'", ".", "...", "!", "é", "×", "日", "1", "23", "-", "<|endoftext|>", "the", " ", "\x85", "\r\n", "ÿ", "_"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    ids, first = records.encoder(queries.byte_bpe()).texts(*text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == encode(texts)


def test_added_tokens_are_those_of_the_default_tokenizer(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from beatwatch.llm.words import text_bytes

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    whole = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    draw = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", "'s", ".", "é", "日", "1", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "the", " b", "\r\n"]
    texts = ["a<|endoftext|>b", "<|endof", "text|>", *("".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(4000)), "<|endoftext|>"]
    ids, first = records.encoder(queries.byte_bpe(), added=True).texts(*text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == whole(texts)
    rows = list(enumerate(texts[:5]))
    got = records.encoded_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_bpe).collect()
    assert next(r["ids"] for r in got if r["doc_id"] == 0) == [64, 50256, 65, 0]
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in got) == [(d, start, ids.tolist()) for d, start, ids in brute.token_records(rows, whole)]


def test_records_round_trip(spark, docs, rows, encode, tmp_path):
    where = str(tmp_path / "out")
    manifest = records.write_records(docs, where, queries.byte_bpe, file_bytes=100_000)
    assert manifest.count() > 3
    want = brute.token_records([r[:2] for r in rows], encode)
    read = {r["doc_id"]: r["ids"] for r in records.read_records(spark, where).collect()}
    assert read == {d: ids.tolist() for d, _, ids in want}
    mixed = [(r["doc_id"], list(r["ids"])) for r in records.read_shuffled(spark, where, 3).collect()]
    assert sorted(mixed) == sorted(read.items()) and mixed != sorted(mixed)
    digests = by_id(queries.op9_token_records(spark, SF))
    for d, start, ids in want:
        assert (digests[d]["start"], digests[d]["n_tokens"], digests[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def test_broken_frames_are_noticed():
    body = records.pack_body(None, np.array([1, 70_000]))
    assert records.unpack_body(body)[0] is None and records.unpack_body(body)[1].tolist() == [1, 70_000]
    data = records.frame(body) + records.frame(b"")
    assert list(records.frames(data)) == [body, b""]
    for at in (0, 9, 15, len(data) - 1):
        with pytest.raises(ValueError, match="broken"):
            list(records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError, match="broken"):
        list(records.frames(data[:-2]))


def test_record_edges(edge, empty):
    got = records.encoded_documents(edge, queries.byte_bpe).collect()
    assert len(got) == edge.count()
    assert [r["ids"] for r in got if r["doc_id"] == 0] == [[0]]
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda d: -1 if d is None else d)
    assert all(a["start"] + len(a["ids"]) == b["start"] for a, b in zip(order, order[1:]))
    assert records.encoded_documents(empty, queries.byte_bpe).count() == 0


# Decontamination ----------------------------------------------------------------------------


def test_contaminated(docs, rows, spark):
    items = [tuple(r) for r in queries.benchmark(spark, SF).select("item_id", "text").collect()]
    got = by_id(queries.op10_benchmark_tiling(spark, SF))
    assert {d: r["item_ids"] for d, r in got.items()} == brute.contaminated([r[:2] for r in rows], items)
    assert all(r["contaminated"] == bool(r["item_ids"]) != r["kept"] for r in got.values())


def test_tiling_is_greedy_and_catches_reordering():
    draw = random.Random(5)
    for _ in range(300):
        item = [draw.choice("abcdef") for _ in range(draw.randint(0, 25))]
        text = [draw.choice("abcdef") for _ in range(draw.randint(0, 40))]
        for _ in range(2):
            a, at = draw.randint(0, len(item)), draw.randint(0, len(text))
            text[at:at] = item[a : a + 12]
        h = lambda w: np.array([ord(c) for c in w], np.uint64)
        assert sum(n for *_, n in tiling.tiles(h(item), h(text))) == brute.tiling(item, text)


def test_tiling_of_long_repetitive_texts():
    h = lambda w: words.mix64(np.array(w, np.uint64))
    # one word throughout: a single tile as long as the item
    assert tiling.tiles(h([1] * 1000), h([1] * 100_000)) == [(0, 0, 1000)]
    draw = random.Random(9)
    for kinds in (1, 2, 3):
        for _ in range(100):
            item, text = ([draw.randrange(kinds) for _ in range(draw.randint(0, most))] for most in (50, 90))
            assert sum(n for *_, n in tiling.tiles(h(item), h(text))) == brute.tiling(item, text)


def test_equal_hashes_of_different_words_are_no_match(monkeypatch):
    monkeypatch.setattr(words, "mix64", lambda x: x % np.uint64(7))
    draw = random.Random(10)
    for _ in range(60):
        item, text = ([draw.randrange(4) for _ in range(draw.randint(0, most))] for most in (30, 60))
        found = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64))
        assert all(item[x : x + n] == text[y : y + n] for x, y, n in found)
        assert sum(n for *_, n in found) == brute.tiling(item, text)


def test_pairs_that_cannot_reach_the_coverage_are_left_out(spark):
    w = COPY.split()
    shared = " ".join(w[:5])
    docs = spark.createDataFrame([(1, f"{shared} other words"), (2, COPY), (3, " ".join(w[3:15]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, COPY), (2, f"{shared} " * 3)], "item_id long, text string")
    every, _ = tiling.matches(docs, items)
    some, _ = tiling.matches(docs, items, reach=0.5)
    pairs = lambda df: {(r["doc_id"], r["item_id"]): r["coverage"] for r in df.collect()}
    assert pairs(every).keys() == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}
    assert (1, 1) not in pairs(some)
    assert {p for p, c in pairs(every).items() if c >= 0.5} <= pairs(some).keys()
    assert {r["doc_id"] for r in tiling.without_contaminated(docs, items).collect()} == {r["doc_id"] for r in tiling.contaminated(docs, items).collect() if r["kept"]}


def test_contamination_edges(spark, edge, empty):
    w = COPY.split()
    items = spark.createDataFrame([(1, " ".join(w[10:] + w[:10])), (2, None), (3, ""), (4, "one two"), (5, "nothing of this is found in any text"), (None, COPY)], "item_id long, text string")
    items = items.withColumn("key", F.lit(1))
    got = tiling.contaminated(edge, items).collect()
    assert len(got) == edge.count()
    assert {r["doc_id"] for r in got if r["contaminated"]} == {5, 6, 7, 8, None} - {None} and all(r["item_ids"] in ([], [1]) for r in got)
    assert tiling.contaminated(empty, items).count() == 0
    assert not any(r["contaminated"] for r in tiling.contaminated(edge, items.limit(0)).collect())
    left = tiling.without_contaminated(edge, items)
    assert left.columns == edge.columns and left.count() == edge.count() - 5
