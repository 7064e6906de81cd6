"""Repeated passages by recompression of the word sequence.

Rounds of run and pair naming shorten every text in the same way: a run of equal symbols gets a name from
symbol and length, then a symbol of the left class and a following symbol of the right class get a name
from both. Names and classes are hashes of content, so they agree in all tasks without a table, and equal
substrings get equal symbols but for those near their ends. For each symbol the words that decide about
it are tracked; a repeated window holds equal symbols wherever all deciding words lie inside it. The
corpus is asked which symbols it has twice; windows with a symbol that is found once are done, and
the rest are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beatwatch.llm import blocks as B
from beatwatch.llm.words import find_words, gram_hashes, gram_places, mix64
from beatwatch.session import shared_dir

WINDOW = 20
ROUNDS = 4
U = np.uint64
FAR = 1 << 40


def _after(values: np.ndarray, last: np.ndarray, beyond: int) -> np.ndarray:
    """The value of the next symbol; ``beyond`` at the end of a text."""
    out = np.empty_like(values)
    out[:-1] = values[1:]
    out[last] = beyond
    return out


def _before(values: np.ndarray, first: np.ndarray, beyond: int) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = beyond
    return out


def parse(symbols: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High-level symbols of texts, and the words [low, high) that decide about each.

    A symbol whose decision looks past an end of its text has its bound far outside, so no window
    holds it.
    """
    low = np.arange(len(symbols), dtype=np.int64)
    high = low + 1
    for turn in range(rounds):
        if not len(symbols):
            break
        # runs
        same = np.zeros(len(symbols), bool)
        same[1:] = (symbols[1:] == symbols[:-1]) & (doc[1:] == doc[:-1])
        heads = np.flatnonzero(~same)
        ends = np.append(heads[1:], len(symbols))
        length = ends - heads
        d = doc[heads]
        edge = np.append(d[1:] != d[:-1], True)
        opening = np.append(True, d[1:] != d[:-1])
        lo, hi = low[heads], high[ends - 1]
        # a run ends where its neighbours differ, so they decide as well
        lo, hi = np.minimum(lo, _before(low[ends - 1], opening, -FAR)), np.maximum(hi, _after(high[heads], edge, FAR))
        with np.errstate(over="ignore"):
            sym = np.where(length > 1, mix64(symbols[heads] * U(3) + length.astype(U) * U(0x9E3779B97F4A7C15) + U(2 * turn + 1)), symbols[heads])
            right = ((mix64(sym + U(turn + 1)) >> U(40)) & U(1)).astype(bool)
        # pairs: left class, then right class
        opens = ~right
        opens[:-1] &= right[1:]
        opens[edge] = False
        closes = np.zeros(len(sym), bool)
        closes[1:] = opens[:-1]
        with np.errstate(over="ignore"):
            nxt = np.roll(sym, -1)
            named = np.where(opens, mix64(sym * U(0xD6E8FEB86659FD93) + mix64(nxt + U(2 * turn + 2))), sym)
        # a symbol that stays alone does so for the class of its one neighbour
        hi_next, lo_prev = _after(hi, edge, FAR), _before(lo, opening, -FAR)
        new_hi = np.where(~right, np.maximum(hi, hi_next), hi)
        new_lo = np.where(right & ~closes, np.minimum(lo, lo_prev), lo)
        keep = ~closes
        symbols, low, high, doc = named[keep], new_lo[keep], new_hi[keep], d[keep]
    return symbols, low, high


def _windows(row: dict, n: int) -> tuple:
    ids, offsets, data = B.unpack(row)
    words = find_words(data, offsets)
    hashes = words.hashes()
    symbols, low, high = parse(hashes, words.doc)
    # only symbols that some window can hold are of use
    use = (low >= 0) & (high - low <= n)
    return ids, words, hashes, symbols[use], low[use], high[use]


def _twice(stage: int, keys: list[np.ndarray], extras: list[bytes]) -> tuple[list[bytes], int, int]:
    """Which keys are in two blocks or more, or twice in one."""
    held = np.sort(np.concatenate(keys))
    many = held[1:][held[1:] == held[:-1]]
    more = [k[np.unpackbits(np.frombuffer(e, np.uint8), count=len(k)).astype(bool)] for k, e in zip(keys, extras)]
    many = np.unique(np.concatenate([many, *more]))
    return [np.packbits(np.isin(k, many, assume_unique=True)).tobytes() for k in keys], 0, 0


def _first(stage: int, keys: list[np.ndarray], extras: list[bytes]) -> tuple[list[bytes], int, int]:
    """Which keys no earlier block has."""
    cut = np.cumsum([0, *map(len, keys)])
    held = np.concatenate(keys)
    order = np.argsort(held, kind="stable")
    lead = np.ones(len(held), bool)
    lead[order[1:]] = held[order[1:]] != held[order[:-1]]
    return [np.packbits(lead[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], 0, 0


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is there."""
    held = np.sort(keys)
    lead = np.concatenate(([True], held[1:] != held[:-1])) if len(held) else np.zeros(0, bool)
    at = np.flatnonzero(lead)
    return held[at], np.diff(np.append(at, len(held)))


def _candidates(row: dict, replies: dict[int, bytes], buckets: int, n: int) -> tuple:
    """Windows without a symbol that the corpus has once: their places and hashes."""
    ids, words, hashes, symbols, low, high = _windows(row, n)
    keys, _ = _distinct(symbols)
    twice = B.read_bits(replies, B.split(keys, buckets), len(keys))
    single = ~twice[np.searchsorted(keys, symbols)] if len(symbols) else np.zeros(0, bool)
    # windows that start in [high - n, low] hold the symbol
    step = np.zeros(len(hashes) + 2, np.int32)
    np.add.at(step, np.maximum(high[single] - n, 0), 1)
    np.add.at(step, low[single] + 1, -1)
    ruled_out = np.cumsum(step[: len(hashes)]) > 0
    at, _ = gram_places(words.first, n)
    at = at[~ruled_out[at]]
    return ids, words, hashes, at, gram_hashes(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document.

    A word goes if a window of ``window`` words over it starts earlier in the corpus as well, by doc_id
    and then by place; kept words are joined by one space. Null, empty and short texts lose nothing.
    Rows that share a doc_id follow each other by text. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "recompression")
    blocks = B.write_blocks(docs, f"{where}/blocks")
    buckets, number = B.counts(blocks)

    def ask_symbols(row: dict) -> Iterator[pa.RecordBatch]:
        *_, symbols, _, _ = _windows(row, window)
        keys, counts = _distinct(symbols)
        yield B.ask(row["block"], keys, buckets, lambda at: np.packbits(counts[at] > 1).tobytes())

    def ask_windows(row: dict, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        *_, found = _candidates(row, replies, buckets, window)
        yield B.ask(row["block"], _distinct(found)[0], buckets, stage=1)

    with B.dropping_shuffles(spark):
        B.answers(B.on_blocks(blocks, ask_symbols, B.ASK), _twice, buckets).write.parquet(f"{where}/symbols")
        symbols = spark.read.parquet(f"{where}/symbols")
        B.answers(B.with_answers(blocks, symbols, ask_windows, B.ASK, number), _first, buckets).write.parquet(f"{where}/windows")
    both = symbols.union(spark.read.parquet(f"{where}/windows"))

    def removed(row: dict, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, words, hashes, at, found = _candidates(row, replies, buckets, window)
        keys, _ = _distinct(found)
        lead = B.read_bits(replies, B.split(keys, buckets), len(keys), stage=1)
        order = np.argsort(found, kind="stable")
        own_first = np.zeros(len(found), bool)
        if len(found):
            own_first[order[np.concatenate(([True], found[order][1:] != found[order][:-1]))]] = True
        again = at[~(own_first & lead[np.searchsorted(keys, found)])] if len(found) else at
        step = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(step, again, 1)
        np.add.at(step, again + window, -1)
        gone = np.cumsum(step[: len(hashes)]) > 0
        yield from _kept(ids, words, gone)

    return B.with_answers(blocks, both, removed, "doc_id long, n_words long, n_removed long, kept_text string", number)


def _kept(ids: np.ndarray, words, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rest of each text, a run of texts at a time."""
    docs = len(ids)
    lost = np.concatenate(([0], np.cumsum(gone)))
    for a in range(0, docs, 2000):
        b = min(docs, a + 2000)
        first = words.first[a : b + 1]
        own = np.arange(first[0], first[-1])[~gone[first[0] : first[-1]]]
        starts, lens = words.starts[own], words.ends[own] - words.starts[own] + 1
        out_at = np.concatenate(([0], np.cumsum(lens)))
        take = np.arange(out_at[-1]) + np.repeat(starts - out_at[:-1], lens)
        body = words.data[np.minimum(take, len(words.data) - 1)] if len(own) else np.zeros(0, np.uint8)
        body[out_at[1:] - 1] = 0x20
        cut = np.searchsorted(own, first)
        texts = [body[out_at[x] : max(out_at[x], out_at[y] - 1)].tobytes().decode() for x, y in zip(cut[:-1], cut[1:])]
        n_words = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[a:b], mask=ids[a:b] == B.NO_ID), pa.array(n_words), pa.array(lost[first[1:]] - lost[first[:-1]]), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )
