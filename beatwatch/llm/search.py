"""Ranked lexical search by Block-Max MaxScore over an index in shards.

A task packs its documents into shards of whole texts; a shard has the postings of all its terms in blocks of ``BLOCK``
documents, each block with its span, its highest factor and its bytes apart. Queries are asked of every shard:
list maxima tell which lists a document must be in to reach the ranking (the essential ones); their documents get the
other lists only while list and block maxima leave room for them, and a block is unpacked only for documents
that are still in. A task carries its ranking on from shard to shard; the rankings of all tasks are merged by Spark.

Terms are runs of ASCII letters, digits and bytes above 0x7F, A-Z lowered. The score of a document is a sum of whole numbers:
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the query's distinct terms, ``m`` being ``10 + (90 * n * N) div L``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.llm.words import Words, chunks, find_words
from beatwatch.session import shared_dir

SHARD_BYTES = 16 << 20
BLOCK = 128
# distinct (item, term) pairs that are asked at once
PAIRS = 50_000
# documents that are scored first, to have a bar for the others
FIRST = 32

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LONG = 1 << 63


def terms_of(words: Words) -> pa.Array:
    """The terms in the order of the text, as binaries."""
    ends = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    body = _LOWER[words.data[_IN_TERM[words.data]]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])


@dataclass(frozen=True)
class Totals:
    """``docs``: documents with a term, ``terms``: all their terms."""

    docs: int
    terms: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents with ``n`` terms."""
        if 90 * self.docs * int(n.max(initial=0)) >= _LONG:
            return np.array([10 + 90 * int(x) * self.docs // self.terms for x in n], np.int64)
        return 10 + 90 * n.astype(np.int64) * self.docs // max(1, self.terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def factors(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def totals(docs: DataFrame) -> Totals:
    """Counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                counts = np.diff(find_words(data, offsets, _IN_TERM).first)
                some, every = some + int((counts > 0).sum()), every + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([every])], names=["docs", "terms"])

    row = docs.selectExpr("cast(text as string) text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return Totals(row[0] or 0, row[1] or 0)


# Byte columns of a shard, each an array of one kind. A term's blocks follow each other in the order of the documents.
ARRAYS = {
    "doc_ids": np.int64,
    "no_id": np.uint8,  # documents without an id
    "m": np.int64,
    "term_ends": np.int64,
    "df": np.int32,
    "low": np.int32,  # first document of a block
    "high": np.int32,  # last one
    "best": np.int32,  # highest factor
    "wide": np.uint8,  # bytes of a document's step, and 16 times those of a frequency
}
SHARD = "shard long, terms binary, " + ", ".join(f"{name} binary" for name in ARRAYS) + ", postings binary"


def _planes(start: np.ndarray, count: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Byte planes of runs of numbers: plane, numbers that have it, and their places in the bytes."""
    run = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    for plane in range(int(width.max(initial=0))):
        has = np.flatnonzero(width[run] > plane)
        yield plane, has, start[run[has]] + plane * count[run[has]] + place[has]


def _width(most: np.ndarray) -> np.ndarray:
    return 1 + (most >> 8 > 0) + (most >> 16 > 0) + (most >> 24 > 0)


def build_shard(number: int, ids: pa.Array, words: Words, total: Totals) -> pa.RecordBatch:
    """The ``SHARD`` row of a run of documents."""
    docs = len(words.first) - 1
    m = total.lengths(np.diff(words.first))
    coded = terms_of(words).dictionary_encode()
    terms = coded.dictionary
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * docs + words.doc)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    tf, key = np.diff(np.append(new, len(key))), key[new]
    code, doc = key // max(1, docs), key % max(1, docs)
    factor = factors(tf, m[doc])
    df = np.bincount(code, minlength=len(terms))
    place = np.arange(len(code)) - np.repeat(np.cumsum(df) - df, df)
    first = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.append(first, len(code)))
    low = doc[first]
    step, more = doc - np.repeat(low, count), tf - 1
    width = [_width(np.maximum.reduceat(x, first) if len(first) else first) for x in (step, more)]
    starts = _starts(count, *width)
    body = np.zeros(int(starts[-1]), np.uint8)
    for values, start, w in ((step, starts[:-1], width[0]), (more, starts[:-1] + count * width[0], width[1])):
        for plane, has, at in _planes(start, count, w):
            body[at] = values[has] >> (8 * plane) & 255
    found = {
        "doc_ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
        "no_id": ids.is_null().to_numpy(zero_copy_only=False),
        "m": m,
        "term_ends": np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, terms.offset * 8) if len(terms) else np.zeros(1),
        "df": df,
        "low": low,
        "high": doc[first + count - 1] if len(first) else low,
        "best": np.maximum.reduceat(factor, first) if len(first) else low,
        "wide": width[0] + 16 * width[1],
    }
    pack = zstandard.ZstdCompressor(level=1).compress
    text = (terms.buffers()[2] or b"") if len(terms) else b""
    row = [number, pack(bytes(text)), *[pack(np.ascontiguousarray(found[k].astype(t)).tobytes()) for k, t in ARRAYS.items()], body.tobytes()]
    kinds = [pa.int64()] + [pa.binary()] * (len(row) - 1)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["shard", "terms", *ARRAYS, "postings"])


def _starts(count: np.ndarray, wide: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where the bytes of each block begin, and the end."""
    return np.concatenate(([0], np.cumsum(count * (wide.astype(np.int64) + more))))


def _array(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _dictionary(row: dict) -> pa.Array:
    ends = _array(row["term_ends"], np.int64)
    body = zstandard.ZstdDecompressor().decompress(row["terms"]) if len(ends) > 1 else b""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])


class Shard:
    """A shard row for reading. A block is unpacked when it is first asked for, and then stays for other items."""

    def __init__(self, row: dict) -> None:
        self.ids, self.no_id, self.m = (_array(row[k], ARRAYS[k]) for k in ("doc_ids", "no_id", "m"))
        self.terms, df = _dictionary(row), _array(row["df"], np.int32).astype(np.int64)
        self.low, self.high, self.best = (_array(row[k], np.int32).astype(np.int64) for k in ("low", "high", "best"))
        wide = _array(row["wide"], np.uint8)
        self.step, self.more = wide & 15, wide >> 4
        # blocks of term t: first[t] to first[t + 1]; postings of block b: place[b] to place[b + 1]
        self.first = np.concatenate(([0], np.cumsum(-(-df // BLOCK))))
        self.count = np.full(len(self.low), BLOCK, np.int64)
        self.count[self.first[1:] - 1] = (df - 1) % BLOCK + 1
        self.place = np.concatenate(([0], np.cumsum(self.count)))
        self.bound = np.maximum.reduceat(self.best, self.first[:-1]) if len(df) else df
        self.starts = _starts(self.count, self.step, self.more)
        self.body = np.frombuffer(row["postings"], np.uint8)
        self.packed = np.ones(len(self.low), bool)
        # a packed block stands there as its last document, so that lists stay in order
        self.doc = np.repeat(self.high, self.count)
        self.factor = np.zeros(len(self.doc), np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and factors of a list; those of packed blocks are not to be used."""
        a, b = self.place[self.first[term]], self.place[self.first[term + 1]]
        return self.doc[a:b], self.factor[a:b]

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[self.packed[blocks]]
        if not len(blocks):
            return
        self.packed[blocks] = False
        count, start = self.count[blocks], self.starts[blocks]
        doc, tf = np.repeat(self.low[blocks], count), np.ones(int(count.sum()), np.int64)
        for into, begin, width in ((doc, start, self.step[blocks]), (tf, start + count * self.step[blocks], self.more[blocks])):
            for plane, has, at in _planes(begin, count, width):
                into[has] += self.body[at].astype(np.int64) << (8 * plane)
        at = np.arange(len(doc)) + np.repeat(self.place[blocks] - (np.cumsum(count) - count), count)
        self.doc[at] = doc
        self.factor[at] = factors(tf, self.m[doc])


@dataclass
class Ranking:
    """The best documents of one item so far: falling scores, then ascending ids, none last."""

    top: int
    score: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray

    @classmethod
    def new(cls, top: int) -> Ranking:
        return cls(top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    @property
    def bar(self) -> int:
        """The score that a document needs; one that equals the last may still come before it."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = np.append(self.score, score), np.append(self.ids, ids), np.append(self.no_id, no_id)
        order = np.lexsort((ids, no_id, -score))[: self.top]
        self.score, self.ids, self.no_id = score[order], ids[order], no_id[order]


def rank_in_shard(shard: Shard, codes: np.ndarray, weights: np.ndarray, ranking: Ranking) -> None:
    """Add the shard's documents that may be among the best to ``ranking``.

    ``codes``: the item's terms that the shard has, ``weights``: theirs.
    """
    bounds = weights * shard.bound[codes]
    order = np.argsort(-bounds, kind="stable")
    codes, weights, bounds = codes[order], weights[order], bounds[order]
    # what lists from i on can add
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    score = np.zeros(len(shard.m), np.int64)
    seen = np.zeros(len(shard.m), bool)

    def essential(start: int, end: int) -> None:
        for i in range(start, end):
            shard.unpack(np.arange(shard.first[codes[i]], shard.first[codes[i] + 1]))
            doc, factor = shard.postings(codes[i])
            score[doc] += weights[i] * factor
            seen[doc] = True

    def complete(doc: np.ndarray, start: int) -> None:
        """Scores of documents by the lists from ``start`` on, dropping those that cannot reach the bar."""
        sums = score[doc]
        for i in range(start, len(codes)):
            stays = sums + left[i] >= ranking.bar
            doc, sums = doc[stays], sums[stays]
            if not len(doc):
                return
            a, b = shard.first[codes[i]], shard.first[codes[i] + 1]
            block = a + np.searchsorted(shard.high[a:b], doc)
            inside = block < b
            block = np.minimum(block, b - 1)
            inside &= shard.low[block] <= doc
            stays = sums + np.where(inside, weights[i] * shard.best[block], 0) + left[i + 1] >= ranking.bar
            doc, sums, block, inside = doc[stays], sums[stays], block[stays], inside[stays]
            if not inside.any():
                continue
            shard.unpack(np.unique(block[inside]))
            there, factor = shard.postings(codes[i])
            at = np.searchsorted(there, doc)
            at[~inside] = 0
            hit = inside & (there[at] == doc)
            sums[hit] += weights[i] * factor[at[hit]]
        stays = sums >= ranking.bar
        ranking.add(sums[stays], shard.ids[doc[stays]], shard.no_id[doc[stays]])

    # the lists with the highest maxima give some documents, and these a bar for the rest
    e, have = 0, 0
    while e < len(codes) and have < ranking.top and left[e] >= ranking.bar:
        have += len(shard.postings(codes[e])[0])
        e += 1
    essential(0, e)
    found = np.flatnonzero(seen)
    ahead = np.sort(found[np.argsort(-score[found], kind="stable")[:FIRST]])
    complete(ahead, e)
    # a list is essential while all from it on can reach the bar
    last = e
    while last < len(codes) and left[last] >= ranking.bar:
        last += 1
    rest = seen.copy()
    rest[ahead] = False
    essential(e, last)
    rest |= seen
    rest[ahead] = False
    complete(np.flatnonzero(rest), last)


def build_index(docs: DataFrame, where: str, total: Totals | None = None) -> tuple[DataFrame, Totals]:
    """The index of ``doc_id, text``, written to ``where``, and the counts that its factors are made with.

    No text is shuffled: a task makes shards of some ``SHARD_BYTES`` of the whole texts it reads.
    """
    total = total or totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        data: list[np.ndarray] = []
        lens: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
            return build_shard(number, pa.concat_arrays(ids), find_words(np.concatenate(data), offsets, _IN_TERM), total)

        for batch in batches:
            for row, end, body, offsets in chunks(batch.column(1)):
                ids.append(batch.column(0).slice(row, end - row))
                data.append(body)
                lens.append(np.diff(offsets))
                if sum(map(len, data)) >= SHARD_BYTES:
                    yield shard()
                    number, ids, data, lens = number + 1, [], [], []
        if ids:
            yield shard()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows.mapInArrow(run, SHARD).write.option("compression", "none").parquet(where)
    return docs.sparkSession.read.parquet(where), total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How many documents of all shards hold each of ``terms``; the postings are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _rows(batches):
            at = pc.index_in(terms, value_set=_dictionary(row))
            has = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            total[has] += _array(row["df"], np.int32)[at.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms", "term_ends", "df").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(terms), np.int64)
    for r in found:
        out[r["term"]] = r["df"]
    return out


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``item_id, term`` of all items; rows that share an id, or have none, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                words = find_words(data, offsets, _IN_TERM)
                ids = batch.column(0).slice(row, end - row).take(pa.array(words.doc))
                yield pa.RecordBatch.from_arrays([ids, terms_of(words).cast(pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


RANKED = "part int, item int, doc_id long, score long"


def rank(index: DataFrame, total: Totals, queries: list[tuple[np.ndarray, np.ndarray]], terms: pa.Array, top: int) -> DataFrame:
    """``RANKED`` rows: each task's best documents for each query, a pair of places in ``terms`` and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking.new(top) for _ in queries]
        for row in _rows(batches):
            shard = Shard(row)
            codes = pc.fill_null(pc.index_in(terms, value_set=shard.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for (at, weights), ranking in zip(queries, rankings):
                has = codes[at] >= 0
                if has.any():
                    rank_in_shard(shard, codes[at[has]], weights[has], ranking)
        part = TaskContext.get().partitionId() % 64
        item = np.repeat(np.arange(len(queries), dtype=np.int32), [len(r.score) for r in rankings])
        ids, none, score = (np.concatenate([getattr(r, k) for r in rankings]) for k in ("ids", "no_id", "score"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(item), part, np.int32)), pa.array(item), pa.array(ids, mask=none.astype(bool)), pa.array(score)],
            names=["part", "item", "doc_id", "score"],
        )

    return index.mapInArrow(run, RANKED)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``, ranks from 1, only scores above 0.

    Equal scores are ranked by ascending doc_id, those without an id last. Null texts have no terms; documents without
    terms are not counted. Each row of ``docs`` is a document of its own, also where ids repeat; rows of ``items`` that
    share an id, or have none, are one item with the terms of all. Items without terms and an empty
    table on either side give no rows. Other columns are ignored. Items are asked in blocks of some ``PAIRS`` terms.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "search")
    item_terms(items).write.parquet(f"{where}/items")
    pairs = spark.read.parquet(f"{where}/items")
    n_blocks = max(1, math.ceil(pairs.count() / PAIRS))
    index, total = build_index(docs, f"{where}/index")
    parts: list[str] = []
    for block in range(n_blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "term").toArrow()
        if not mine.num_rows or not total.docs:
            continue
        coded = mine.column("term").cast(pa.large_binary()).combine_chunks().dictionary_encode()
        terms, place = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        weight = np.array([total.weight(int(df)) if df else 0 for df in frequencies(index, terms)], np.int64)
        ids = mine.column("item_id").to_pylist()
        cut = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        queries = [(place[a:b][weight[place[a:b]] > 0], weight[place[a:b]][weight[place[a:b]] > 0]) for a, b in zip(cut, cut[1:])]
        names = spark.createDataFrame([(i, ids[a]) for i, a in enumerate(cut[:-1])], "item int, item_id long")
        found = rank(index, total, queries, terms, top)
        for by in (["item", "part"], ["item"]):
            # by groups of tasks first, so that no item gathers the rows of all tasks at once
            place_in = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            found = found.withColumn("rank", place_in).filter(F.col("rank") <= top)
        parts.append(f"{where}/ranked/{block}")
        found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.parquet(parts[-1])
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.parquet(*parts)
