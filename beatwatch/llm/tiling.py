"""Benchmark decontamination by greedy string tiling.

Seeds of five shared words join documents with benchmark items. Each joined pair is tiled: the longest
common runs of words that no earlier tile has marked are found by Karp-Rabin hashes of falling lengths,
marked, and the search repeated down to the least tile. The share of the item's words under tiles decides,
so a passage whose pieces were put into another order is caught as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.llm.words import Rolled, chunks, find_words, gram_places
from beatwatch.session import shared_dir

SEED = 5
COVERAGE = 0.5
# the seed filter has 2^24 bits, 2 MB, whatever the benchmark holds; a seed sets two of them
FILTER_BITS = 24


def seed_hashes(hashes: np.ndarray, n: int = SEED) -> np.ndarray:
    """Distinct hashes of the ``n``-word runs of a word array."""
    return np.unique(Rolled(hashes).grams(n))


def may_be_seed(own: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set."""
    hit = np.ones(len(own), bool)
    for shift in (64 - FILTER_BITS, 64 - 2 * FILTER_BITS):
        place = (own >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        hit &= (keep[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _free_starts(free: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` words are unmarked."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    held = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(held[n:] == held[:-n])


def _mark(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, keys: tuple, n: int) -> list[tuple[int, int, int]]:
    """Tiles of ``n`` words: from the left, each unmarked run of the item takes the first equal one of the text.

    The text's places of a hash stand together in ascending order with one pointer. Marked places stay marked, so the
    pointer only goes forward and no list of pairs is needed. Hashes propose, words confirm.
    """
    at_i, own, at_t, theirs = keys
    order = np.argsort(theirs, kind="stable")
    places, theirs = at_t[order], theirs[order]
    left, right = np.searchsorted(theirs, own, "left"), np.searchsorted(theirs, own, "right")
    pointer: dict[int, int] = {}
    out = []
    for k in np.flatnonzero(right > left).tolist():
        x, begin, end = int(at_i[k]), int(left[k]), int(right[k])
        # tiles of this round have n words as well, so one that overlaps a run covers an end of it
        if not (free_i[x] and free_i[x + n - 1]):
            continue
        at = pointer.get(begin, begin)
        while at < end and not (free_t[places[at]] and free_t[places[at] + n - 1]):
            at += 1
        pointer[begin] = at
        for y in places[at:end]:
            if free_t[y] and free_t[y + n - 1] and (item[x : x + n] == text[y : y + n]).all():
                out.append((x, int(y), n))
                free_i[x : x + n] = False
                free_t[y : y + n] = False
                break
    return out


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word arrays: (start in item, start in text, length), longest tiles first.

    The longest length with a common unmarked run is found by halving (a run of n words holds runs of all
    shorter lengths), its runs are marked from the left, and the search goes on with what is unmarked. A round sorts the item's
    hashes and looks the text's up; each round marks a length of its own, so there are at most as many as the root of twice the item's words.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    rolled_i, rolled_t = Rolled(item), Rolled(text)
    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(text))
    while top >= least:
        low, high, best = least, top, None
        while low <= high:
            n = (low + high) // 2
            at_i, at_t = _free_starts(free_i, n), _free_starts(free_t, n)
            own, theirs = rolled_i.grams(n, at_i), rolled_t.grams(n, at_t)
            known = np.sort(own)
            hit = known[np.minimum(np.searchsorted(known, theirs), len(known) - 1)] == theirs if len(known) else np.zeros(len(theirs), bool)
            if hit.any():
                best, low = (at_i, own, at_t[hit], theirs[hit]), n + 1
            else:
                high = n - 1
        if best is None:
            break
        out += _mark(item, text, free_i, free_t, best, high)
        top = high - 1
    return out


def _seeded(df: DataFrame, key: str, least: int, keep: np.ndarray | None) -> DataFrame:
    """``key, text, n_words, seeds`` of each row; with a filter, distinct seeds, and rows without a seed in it have none.

    Without one, a seed stands as often as the text has it, and a text shorter than a seed is its own seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for row, end, data, offsets in chunks(column):
                words = find_words(data, offsets)
                hashes = words.hashes(lower=True)
                at, counts = gram_places(words.first, least)
                own = Rolled(hashes).grams(least, at)
                doc = np.repeat(np.arange(len(counts)), counts)
                if keep is not None:
                    hit = may_be_seed(own, keep)
                    own, doc = own[hit], doc[hit]
                cut = np.searchsorted(doc, np.arange(len(counts) + 1))
                seeds: list = [[]] * len(counts)
                for d in np.flatnonzero(np.diff(cut)).tolist():
                    held = own[cut[d] : cut[d + 1]]
                    seeds[d] = (held if keep is None else np.unique(held)).view(np.int64)
                n_words = np.diff(words.first)
                if keep is None:
                    for d in np.flatnonzero((n_words > 0) & (n_words < least)).tolist():
                        part = hashes[words.first[d] : words.first[d + 1]]
                        seeds[d] = Rolled(part).grams(len(part)).view(np.int64)
                texts = column.take(pa.array([row + d if len(s) else None for d, s in enumerate(seeds)], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(row, end - row), texts, pa.array(n_words), pa.array(seeds, pa.list_(pa.int64()))],
                    names=[key, "text", "n_words", "seeds"],
                )

    return df.selectExpr(f"cast({key} as long) {key}", "cast(text as string) text").mapInArrow(run, f"{key} long, text string, n_words long, seeds array<long>")


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """Bits for the two top parts of each seed hash: 2 MB for any benchmark. Full, it keeps every document."""
    parts = [F.shiftrightunsigned("seed", 64 - n * FILTER_BITS) % (1 << FILTER_BITS) for n in (1, 2)]
    words = seeds.select(F.explode(F.array(*parts)).alias("p")).selectExpr("p div 64 as w", "shiftleft(1L, cast(p % 64 as int)) as bit")
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def matches(docs: DataFrame, items: DataFrame, *, least: int = SEED, reach: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Tiled pairs ``doc_id, item_id, tiles, tiled_words, item_words, coverage`` and ``doc_id, n_words`` of all rows.

    Only pairs that share a seed are tiled, so a pair without a common run of ``least`` words is absent.
    An item shorter than ``least`` words has no run of that length and matches nothing. Pairs whose coverage cannot come to
    ``reach`` are left out before a text is moved: tiled words lie in shared seeds, so the item's places of these seeds
    times ``least`` bound them.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "tiling")
    _seeded(items, "item_id", least, None).write.parquet(f"{where}/items")
    # an item's null id is dropped with its text: nothing could be reported for it
    known = spark.read.parquet(f"{where}/items").filter("item_id is not null and text is not null")
    item_seeds = known.filter(F.col("n_words") >= least).select("item_id", "n_words", F.explode("seeds").alias("seed"))
    item_seeds = item_seeds.groupBy("item_id", "seed").agg(F.count("*").alias("places"), F.min("n_words").alias("words"))
    keep = _filter_of(item_seeds)
    _seeded(docs, "doc_id", least, keep).write.parquet(f"{where}/docs")
    seen = spark.read.parquet(f"{where}/docs")
    held = seen.filter("text is not null and doc_id is not null").select("doc_id", "text", "seeds", F.xxhash64("text").alias("body"))
    # equal texts are tiled once; the texts stay with the pairs and are not gathered by item
    bodies = held.groupBy("body", "text").agg(F.first("seeds").alias("seeds"), F.min("doc_id").alias("one"))
    shared = bodies.select("body", F.explode("seeds").alias("seed")).join(item_seeds, "seed")
    bound = shared.groupBy("body", "item_id").agg(F.sum("places").alias("places"), F.min("words").alias("words"))
    pairs = bound.filter(F.col("places") * least / F.col("words") >= F.lit(float(reach))).select("body", "item_id")
    ready = pairs.join(bodies.select("body", "text", "one"), "body").join(known.select("item_id", F.col("text").alias("item")), "item_id")
    ready = ready.select("body", "item_id", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(column: pa.Array) -> list[np.ndarray]:
            out = []
            for *_, data, offsets in chunks(column):
                words = find_words(data, offsets)
                hashes = words.hashes(lower=True)
                out += [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text, item in zip(arrays(part.column("text")), arrays(part.column("item"))):
                    found = tiles(item, text, least)
                    total = sum(n for *_, n in found)
                    rows.append((len(found), total, len(item), total / max(1, len(item))))
                columns = [pa.array([r[j] for r in rows]) for j in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("body"), part.column("item_id"), *columns], names=["body", "item_id", "tiles", "tiled_words", "item_words", "coverage"]
                )

    schema = "body long, item_id long, tiles long, tiled_words long, item_words long, coverage double"
    ready.mapInArrow(run, schema).write.parquet(f"{where}/tiled")
    tiled = spark.read.parquet(f"{where}/tiled").join(held.select("doc_id", "body"), "body").drop("body")
    return tiled, seen.select("doc_id", "n_words")


def contaminated(docs: DataFrame, items: DataFrame, *, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Every document with the benchmark items it holds.

    ``doc_id, n_words, item_ids`` (those whose words are covered to ``coverage`` or more, ascending),
    ``best_coverage`` (0 if no seed is shared), ``contaminated`` and ``kept``, its opposite. Null, empty and short texts
    hold nothing; an empty benchmark leaves every document clean; rows that share a doc_id are judged
    together and each returned; repeated items are reported once; other columns are ignored.
    """
    tiled, seen = matches(docs, items, least=least)
    hit = tiled.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("coverage") >= coverage, F.col("item_id")))).alias("item_ids"),
        F.max("coverage").alias("best_coverage"),
    )
    full = seen.join(hit, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage")
    )
    bad = F.size("item_ids") > 0
    return full.withColumn("contaminated", bad).withColumn("kept", ~bad)


def without_contaminated(docs: DataFrame, items: DataFrame, *, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all columns.

    Each row is judged by its own text, whatever its doc_id. Texts go by a 64-bit hash here: a clean one is taken for one
    of ``h`` hit texts with odds of ``h`` in 2^64. Null texts stay.
    """
    body = F.xxhash64(F.col("text").cast("string"))
    tiled, _ = matches(docs.select(body.alias("doc_id"), "text"), items, least=least, reach=coverage)
    bad = tiled.filter(F.col("coverage") >= coverage).select(F.col("doc_id").alias("_body")).distinct()
    return docs.join(bad, F.col("text").isNotNull() & (body == F.col("_body")), "left_anti").select(*docs.columns)
