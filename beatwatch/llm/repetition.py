"""Quality rules on repetition: characters inside repeated n-grams and lines of a text.

One rolling hash of the words gives the n-gram hashes of all lengths in numpy. All words of all n-grams that
are found twice in a text, the first included, are covered; coverage is the share of the word characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beatwatch.llm.words import Rolled, Words, chunks, find_words, gram_places, mix64

# largest share of the characters that repeated n-grams of a length may cover
MOST_COVERED: Mapping[int, float] = {5: 0.30, 6: 0.28, 8: 0.26, 10: 0.25}
MOST_LINE_CHARS = 0.30
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, covered array<long>"
)


def repeated_in_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have their key twice or more in the same text."""
    with np.errstate(over="ignore"):
        own = mix64(keys + mix64(doc.astype(np.uint64)))
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own


def covered_words(words: Words, rolled: Rolled, n: int) -> np.ndarray:
    """Which words lie in an n-gram that the text has twice or more."""
    at, counts = gram_places(words.first, n)
    step = np.zeros(len(words.starts) + 1, np.int32)
    if len(at):
        found = at[repeated_in_text(rolled.grams(n, at), np.repeat(np.arange(len(counts)), counts))]
        np.add.at(step, found, 1)
        np.add.at(step, found + n, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated_lines(words: Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word that equal an earlier line, and the word characters in them.

    Lines are compared as they stand, blanks included.
    """
    data, offsets, docs = words.data, words.offsets, len(words.offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    if not len(starts) or not len(words.starts):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    all_starts = starts
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 0x0A, ends - 1, ends)
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    keep = last > first
    starts, ends, first, last = starts[keep], ends[keep], first[keep], last[keep]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # the key of a line: prefix sums of scrambled (place in line, byte)
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=np.uint64) - np.repeat(all_starts, np.diff(np.append(all_starts, len(data)))).astype(np.uint64)
        rolled = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix64((place << np.uint64(8)) | data.astype(np.uint64)), out=rolled[1:])
        keys = mix64(rolled[ends] - rolled[starts] + (ends - starts).astype(np.uint64))
    order = np.lexsort((starts, keys, doc))
    k, d = keys[order], doc[order]
    again = order[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    lines = np.bincount(doc[again], minlength=docs).astype(np.int64)
    held = np.zeros(docs, np.int64)
    np.add.at(held, doc[again], total[last[again]] - total[first[again]])
    return lines, held


def measure(data: np.ndarray, offsets: np.ndarray, most: Mapping[int, float], most_line_chars: float) -> dict[str, np.ndarray]:
    words = find_words(data, offsets)
    rolled = Rolled(words.hashes())
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[words.ends] - points[words.starts]
    word_chars = per_doc(chars, words.first)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    n_words = np.diff(words.first)
    lines, line_chars = repeated_lines(words, chars)
    five = covered_words(words, rolled, 5)
    repeat = per_doc(five, words.first)
    covered = np.stack([per_doc(chars * (five if n == 5 else covered_words(words, rolled, n)), words.first) for n in most], axis=1)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    limits = np.array(list(most.values()))
    good = (covered <= limits * word_chars[:, None]).all(axis=1) & (line_chars <= most_line_chars * word_chars)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": lines,
        "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & good, "dup_line_chars": line_chars, "covered": covered,
    }


def quality(docs: DataFrame, *, most: Mapping[int, float] = MOST_COVERED, most_line_chars: float = MOST_LINE_CHARS) -> DataFrame:
    """``SCHEMA``: measures and verdict of every document; ``covered`` follows the lengths of ``most``.

    A null or empty text has no words and fails; rows that share a doc_id are judged each by itself; an
    empty table gives no rows; other columns are ignored. One narrow pass: no shuffle, and the memory of
    a task is bounded by a batch and the longest text.
    """
    most = dict(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                found = measure(data, offsets, most, most_line_chars)
                covered = found.pop("covered")
                columns = {"doc_id": batch.column("doc_id").slice(row, end - row)} | {k: pa.array(v) for k, v in found.items()}
                columns["covered"] = pa.array(covered.tolist(), kind)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, *, most: Mapping[int, float] = MOST_COVERED, most_line_chars: float = MOST_LINE_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    most = dict(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                kept = measure(data, offsets, most, most_line_chars)["kept"]
                yield batch.slice(row, end - row).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
