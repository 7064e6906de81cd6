"""Near-duplicate documents by b-bit MinHash.

A text's set is its distinct five-word shingles. Of each of 128 minima the two low bits are kept, packed
into four longs; bands of four whole minima find candidates, and the packed bits estimate the similarity of
a candidate pair, corrected for minima that agree in their low bits by chance. What passes is confirmed on
the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.llm.blocks import dropping_shuffles
from beatwatch.llm.graph import components
from beatwatch.llm.rows import numbered
from beatwatch.llm.words import chunks, find_words, gram_hashes, mix64, odd_numbers
from beatwatch.session import scratch, shared_dir

SHINGLE = 5
MINIMA = 128
BITS = 2
BAND = 4
# standard deviations of the estimate that a pair at the threshold may fall below it
DEVIATIONS = 6
TILE = 1024
# 32-bit hashes kept of a set to compare it in tiles; larger sets are estimated from so many
BOTTOM = 1024

_A = (odd_numbers(MINIMA, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = odd_numbers(MINIMA, 12).astype(np.uint32)

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one shingle of all words where there are fewer than ``n``."""
    words = find_words(data, offsets)
    hashes = words.hashes(lower=True)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums of scrambled hashes for each set; zero for an empty one."""
    out = np.zeros((len(sets), 2), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        with np.errstate(over="ignore"):
            out[some, 0] = np.add.reduceat(mix64(flat), at)
            out[some, 1] = np.add.reduceat(mix64(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return out.view(np.int64)


def pack_planes(minima: np.ndarray) -> np.ndarray:
    """The low bits of (texts, 128) minima as four longs a text: plane of bit 0, then of bit 1."""
    planes = [np.packbits(((minima >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), axis=1) for bit in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``SKETCH`` of every document; texts without words have size 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                sizes = np.array([len(s) for s in sets], np.int64)
                prints = fingerprints(sets)
                some = np.flatnonzero(sizes)
                bands = np.zeros((len(sets), MINIMA // BAND), np.int64)
                planes = np.zeros((len(sets), 4), np.int64)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.zeros(len(some), np.int64)
                    np.cumsum(sizes[some][:-1], out=at[1:])
                    with np.errstate(over="ignore"):
                        low = (flat >> np.uint64(32)).astype(np.uint32)
                        value = np.empty_like(low)
                        minima = np.empty((MINIMA, len(some)), np.uint32)
                        for k in range(MINIMA):
                            np.multiply(low, _A[k], out=value)
                            value += _B[k]
                            minima[k] = np.minimum.reduceat(value, at)
                        minima = np.ascontiguousarray(minima.T)
                        keys = np.zeros((len(some), MINIMA // BAND), np.uint64) + np.arange(1, MINIMA // BAND + 1, dtype=np.uint64)
                        for j in range(BAND):
                            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, j::BAND].astype(np.uint64))
                    bands[some] = keys.view(np.int64)
                    planes[some] = pack_planes(minima)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, MINIMA // BAND, 0)))).astype(np.int32)), pa.array(bands[some].ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(sizes), *(pa.array(prints[:, j].copy()) for j in (0, 1)), lists]
                    + [pa.array(planes[:, j]) for j in range(4)],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "s0", "s1", "s2", "s3"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SKETCH)


def estimate(left: str, right: str) -> Column:
    """Similarity from the packed bits of ``left.*`` and ``right.*``: (share equal - 1/4) / (1 - 1/4)."""
    part = lambda i, j: F.bit_count((F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))).bitwiseOR(F.col(f"{left}{j}").bitwiseXOR(F.col(f"{right}{j}"))))
    chance = 1.0 / (1 << BITS)
    return (F.lit(1.0) - (part(0, 2) + part(1, 3)) / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1.0 - chance)


def least_estimate(percent: int) -> float:
    """The estimate a pair needs: ``DEVIATIONS`` below the link threshold, rounded down to hundredths."""
    chance = 1.0 / (1 << BITS)
    equal = chance + (1 - chance) * percent / 100
    deviation = math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)
    return math.floor(percent - 100 * DEVIATIONS * deviation) / 100


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, text``: one text of each node ``id, at, fp1, fp2``: that of doc_id ``at`` with the node's fingerprint."""
    found = docs.select(F.col("doc_id").alias("at"), "text").join(nodes.select("id", "at", "fp1", "fp2"), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            got = [fingerprints([s]) for *_, data, offsets in chunks(column) for s in shingle_sets(data, offsets)]
            want = zip(batch.column("fp1").to_pylist(), batch.column("fp2").to_pylist())
            yield batch.select(["id", "text"]).filter(pa.array([tuple(g[0].tolist()) == w for g, w in zip(got, want)], pa.bool_()))

    return found.mapInArrow(run, "id long, text string").dropDuplicates(["id"])


def private_shingles(texts: DataFrame) -> DataFrame:
    """``id, private``: shingles of a node that no other node of ``texts`` has. Counts combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                ids = np.repeat(batch.column("id").to_numpy()[row:end], [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat.view(np.int64))], names=["id", "shingle"])

    rows = texts.mapInArrow(run, "id long, shingle long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return once.groupBy("id").agg(F.count("*").alias("private"))


def may_be_similar(n: Column, p: Column, m: Column, q: Column, num: int, den: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles, ``p`` and ``q`` of them private, can reach the threshold.

    At most the smaller rest is shared, and the private shingles of both are in the union besides it.
    """
    shared = F.least(n - p, m - q)
    return den * shared >= num * (shared + p + q)


def similar_pairs(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` whose full sets have ``den * intersection >= num * union``."""
    side = lambda n: texts.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = []
                one, two = part.column("text_a").dictionary_encode(), part.column("text_b")
                left = [s for *_, data, offsets in chunks(one.dictionary) for s in shingle_sets(data, offsets)]
                right = (s for *_, data, offsets in chunks(two) for s in shingle_sets(data, offsets))
                for code, b in zip(one.indices.to_pylist(), right):
                    a = left[code] if code is not None else b[:0]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(bool(both) and den * both >= num * (len(a) + len(b) - both))
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def bottom_values(texts: DataFrame, seed: int) -> DataFrame:
    """``id, vals``: the least ``BOTTOM`` 32-bit hashes of each node's set, sorted; the whole set if it is that small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                with np.errstate(over="ignore"):
                    vals = [np.unique((mix64(s + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32))[:BOTTOM].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, end - row), pa.array(vals, pa.binary())], names=["id", "vals"])

    return texts.mapInArrow(run, "id long, vals binary")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each array of ``one`` shares with each of ``two``: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(one), len(two)), np.float32)
    if not one or not two:
        return out
    flat = [np.concatenate(side) for side in (one, two)]
    rows = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (one, two)]
    both = np.intersect1d(*flat)
    for at in range(0, len(both), width):
        part = both[at : at + width]
        sides = []
        for v, r, n in zip(flat, rows, (len(one), len(two))):
            place = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[place] == v
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[r[hit], place[hit]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def tile_rows(members: DataFrame, vals: DataFrame) -> DataFrame:
    """The rows of ``members`` with their ``vals``, as often as tiles ``key, t, u`` of their bucket hold them.

    A bucket's largest label and its other rows are dealt over tiles of about ``TILE`` rows. Each tile of the
    others meets each of the main label (``t`` = -1 - its number, ``u`` that of the main tile; ``own`` is
    -1 for main rows) and each other one (``t`` <= ``u``). So no group holds more than two tiles of rows.
    """
    held = ["label", "id", "n_shingles", "private", "s0", "s1", "s2", "s3", "vals"]
    per_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    per_key = per_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels"))
    per_key = per_key.filter("labels > 1").select(
        "key",
        F.col("top.label").alias("main"),
        F.ceil(F.col("top.n") / TILE).cast("int").alias("main_tiles"),
        F.ceil((F.col("all") - F.col("top.n")) / TILE).cast("int").alias("tiles"),
    )
    rows = members.join(per_key, "key").join(vals, "id")
    tile = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    main = rows.filter("label = main").withColumn("u", tile("main_tiles")).withColumn("own", F.lit(-1))
    other = rows.filter("label <> main").withColumn("own", tile("tiles"))
    in_main = main.select("key", each("tiles").alias("o"), "u", "own", *held).select("key", (-1 - F.col("o")).alias("t"), "u", "own", *held)
    against_main = other.select("key", (-1 - F.col("own")).alias("t"), each("main_tiles").alias("u"), "own", *held)
    with_each = other.select("key", each("tiles").alias("o"), "own", *held)
    among = with_each.select("key", F.least("own", "o").alias("t"), F.greatest("own", "o").alias("u"), "own", *held)
    return in_main.union(against_main).union(among)


def cross_links(members: DataFrame, vals: DataFrame, least: float, num: int, den: int) -> DataFrame:
    """Pairs ``a < b`` that join different labels of a bucket, and whether they were compared ``whole``.

    ``members``: key, label, id, n_shingles, private, s0..s3. A bucket of any size is compared whole, tile by
    tile, by many tasks of bounded memory. A pair whose packed bits reach ``least`` is
    counted on 32-bit hashes of its sets. Of pairs of whole sets that pass, a tile gives one for each two labels that it
    joins; those of larger sets, whose least hashes only estimate, are all given.
    """
    margin = 6 * (num / den * (1 - num / den) / BOTTOM) ** 0.5

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        t, u = key[1].as_py(), key[2].as_py()
        own = table.column("own").to_numpy()
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy().copy()
        private, n = table.column("private").to_numpy(), table.column("n_shingles").to_numpy()
        sig = np.stack([table.column(f"s{j}").to_numpy() for j in range(4)], axis=1)
        sets = [np.frombuffer(v, np.uint32) for v in table.column("vals").to_pylist()]
        large = n > BOTTOM
        first, second = (np.flatnonzero(own >= 0), np.flatnonzero(own < 0)) if t < 0 else (np.flatnonzero(own == t), np.flatnonzero(own == u))
        counts = shared_counts([sets[i] for i in first], [sets[j] for j in second])
        found: list[tuple[int, int, bool]] = []
        for row, i in enumerate(first.tolist()):
            unlike = (sig[second, :2] ^ sig[i, :2]) | (sig[second, 2:] ^ sig[i, 2:])
            # of a signed number numpy would count the bits of its absolute value
            share = 1 - np.bitwise_count(unlike.view(np.uint64)).sum(axis=1) / MINIMA
            rest = np.minimum(n[second] - private[second], n[i] - private[i])
            able = den * rest >= num * (rest + private[second] + private[i])
            may = ((share - 0.25) / 0.75 >= least) & (label[second] != label[i]) & able
            both = counts[row]
            exact = ~large[second] & (not large[i])
            hit = second[may & exact & (den * both >= num * (n[second] + n[i] - both))]
            kinds, at = np.unique(label[hit], return_index=True)
            for kind, j in zip(kinds.tolist(), hit[at].tolist()):
                found.append((i, j, True))
                label[label == kind] = label[i]
            for place in np.flatnonzero(may & ~exact).tolist():
                j = int(second[place])
                # below the lesser of the two largest kept hashes both sets are known
                end = min(sets[i][-1] if large[i] else 0xFFFFFFFF, sets[j][-1] if large[j] else 0xFFFFFFFF)
                union = np.searchsorted(sets[i], end, "right") + np.searchsorted(sets[j], end, "right") - both[place]
                if both[place] >= (num / den - margin) * union:
                    found.append((i, j, False))
        one, two = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
        pairs = np.stack([np.minimum(ids[one], ids[two]), np.maximum(ids[one], ids[two])]) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1], "whole": pa.array([f[2] for f in found], pa.bool_())})

    found = tile_rows(members, vals).groupBy("key", "t", "u").applyInArrow(compare, "a long, b long, whole boolean")
    return found.distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets (Jaccard
    0.8 or more is what bands and margin are laid out for). A component is named by its smallest doc_id,
    which is the one kept. A null doc_id is kept and linked with nothing. Null, empty and blank texts have size 0 and are linked with nothing. Equal sets
    are one node from the start. Rows that share a doc_id are one document: each is returned, and a link
    of one holds for all. An empty table gives no rows; other columns are ignored.

    Shingles that only one node has bound its similarity to all others, which settles without a pair the nodes that
    are too far from every other. Each other node is first confirmed against the best of the pivots of
    its band buckets, the nodes with the least share of private shingles. Then all pairs of still
    different components in a bucket are estimated and counted in tiles, and those that join
    components are confirmed on the full sets, so no link between components is left out.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands and margin are laid out for 80 to 100 percent")
    spark = docs.sparkSession
    where = shared_dir(spark, "minhash")
    least = least_estimate(percent)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sketches(docs).write.parquet(f"{where}/sketches")
    all_docs = spark.read.parquet(f"{where}/sketches")
    bits = ["s0", "s1", "s2", "s3"]
    some = all_docs.filter("n_shingles > 0 and doc_id is not null")
    alike = some.groupBy("fp1", "fp2", "n_shingles")
    with dropping_shuffles(spark):
        alike.agg(F.min("doc_id").alias("at"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in bits]).write.parquet(f"{where}/sets")
    nodes = spark.read.parquet(f"{where}/sets")
    # a node is named by its smallest doc_id; where one doc_id has several sets, by a hash of the set
    several = nodes.groupBy("at").agg(F.count("*").alias("_n")).filter("_n > 1").select("at", F.lit(True).alias("_several"))
    nodes = nodes.join(several, "at", "left").withColumn("id", F.when(F.col("_several"), F.xxhash64("fp1", "fp2", "n_shingles")).otherwise(F.col("at"))).drop("_several")

    in_buckets = nodes.select("id", F.explode("bands").alias("key"))
    shared = in_buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    with dropping_shuffles(spark):
        in_buckets.join(shared, "key").write.parquet(f"{where}/in_buckets")
        in_buckets = spark.read.parquet(f"{where}/in_buckets")
        near = nodes.join(in_buckets.select("id").distinct(), "id", "left_semi")
        node_texts(docs, near).write.parquet(f"{where}/texts")
        texts = spark.read.parquet(f"{where}/texts")
        private_shingles(texts).write.parquet(f"{where}/private")
        own = near.join(spark.read.parquet(f"{where}/private"), "id", "left").withColumn("private", F.coalesce("private", F.lit(0).cast("long")))
        own = own.select("id", "n_shingles", "private", *bits)
        # what is too far from all others has no link
        close = 100 * (F.col("n_shingles") - F.col("private")) >= percent * F.col("n_shingles")
        own.filter(close).write.parquet(f"{where}/near")
        near = spark.read.parquet(f"{where}/near")
        in_buckets.join(near, "id").write.parquet(f"{where}/members")
    members = spark.read.parquet(f"{where}/members")

    central = F.struct(F.floor(20 * F.col("private") / F.col("n_shingles")).alias("far"), F.xxhash64("id", "key").alias("h"), "id")
    pivots = members.groupBy("key").agg(F.min(central)["id"].alias("a"))
    pairs = members.select("key", F.col("id").alias("b")).join(pivots, "key").filter("a <> b").select("a", "b").distinct()
    sides = lambda name, p: near.select(F.col("id").alias(name), F.col("n_shingles").alias(f"{p}n"), F.col("private").alias(f"{p}p"), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(bits)])
    scored = pairs.join(sides("b", "y"), "b").join(sides("a", "x"), "a").withColumn("est", estimate("x", "y"))
    able = may_be_similar(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp"), percent, 100)
    best = scored.filter((F.col("est") >= least) & able).groupBy("b").agg(F.max(F.struct("est", "a"))["a"].alias("a"))
    with dropping_shuffles(spark):
        best.select("a", "b").write.parquet(f"{where}/best")
        similar_pairs(spark.read.parquet(f"{where}/best"), texts, percent, 100).write.parquet(f"{where}/links1")
        first = spark.read.parquet(f"{where}/links1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        components(first).write.parquet(f"{where}/labels1")
    links, labels, turn = first, spark.read.parquet(f"{where}/labels1"), 0
    while True:
        turn += 1
        named = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        with dropping_shuffles(spark):
            vals = bottom_values(texts.join(near.select("id"), "id", "left_semi"), turn)
            cross_links(named, vals, least, percent, 100).write.parquet(f"{where}/cross{turn}")
            cross = spark.read.parquet(f"{where}/cross{turn}")
            similar_pairs(cross, texts, percent, 100).write.parquet(f"{where}/links{turn + 1}")
        more = spark.read.parquet(f"{where}/links{turn + 1}")
        links = links.union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        # a pair that two 32-bit hashes only seemed to link may have hidden another one of its labels: look again with other hashes
        if cross.filter("whole").join(more, ["a", "b"], "left_anti").isEmpty():
            break
        components(links).write.parquet(f"{where}/labels{turn + 1}")
        labels = spark.read.parquet(f"{where}/labels{turn + 1}")
    # the sets of one doc_id are one document
    mixed = some.groupBy("doc_id").agg(F.min("fp1").alias("a"), F.max("fp1").alias("b")).filter("a <> b").select("doc_id")
    same = some.select("doc_id", "fp1", "fp2", "n_shingles").join(mixed, "doc_id", "left_semi")
    same = same.join(nodes.select("fp1", "fp2", "n_shingles", "id"), ["fp1", "fp2", "n_shingles"]).select("doc_id", "id").distinct()
    links = links.union(same.join(same.groupBy("doc_id").agg(F.min("id").alias("u")), "doc_id").select("u", F.col("id").alias("v")))

    named = nodes.select("fp1", "fp2", "n_shingles", "id", "at").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("at").alias("component_id"))
    named = named.join(names, "component").select("fp1", "fp2", "n_shingles", "component_id")
    found = some.join(named, ["fp1", "fp2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    empty = all_docs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that with the smallest doc_id, none last.

    Each row is judged by its own text, whatever its doc_id: rows that share an id, or have none, are documents of their
    own. Of rows of a group that share the smallest id the first in the copy stays. Rows without words stay.
    """
    rows, row = numbered(docs)
    kept = shared_dir(docs.sparkSession, "minhash_kept")
    # only the rows that stay are needed later; what led to them is dropped
    with scratch(docs.sparkSession):
        found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=percent)
        ids = rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
        members = found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))["_row"].alias(row))
        first.select(row).write.parquet(kept)
    return rows.join(docs.sparkSession.read.parquet(kept), row, "left_semi").select(*docs.columns)
