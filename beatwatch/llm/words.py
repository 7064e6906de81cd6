"""Words of Arrow text columns as numpy arrays: places, hashes, n-gram hashes.

Words are runs of bytes other than space and the five ASCII control blanks. Nothing here knows of Spark;
tasks call it on their own batches. A text is never cut: a chunk holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_IN_WORD = ~_BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` repeatable odd 64-bit factors."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 % (1 << 64))
        return mix64(steps) | U(1)


_BYTE = odd_numbers(256, 1)
_BYTE_LOWER = _BYTE[_LOWER]
_PLACE = odd_numbers(1 << 12, 2)
_GRAM = odd_numbers(64, 3)
_BASE = int(odd_numbers(1, 4)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Words:
    """Words of a chunk of texts; ``first[d]`` is the number of the first word of text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: sum of byte number times place number, scrambled."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        place = np.arange(int(lens.sum()), dtype=np.int64)
        place -= np.repeat(at, lens)
        longest = int(lens.max())
        places = _PLACE if longest <= len(_PLACE) else odd_numbers(longest, 2)
        with np.errstate(over="ignore"):
            values = (_BYTE_LOWER if lower else _BYTE)[self.data[_IN_WORD[self.data]]]
            values *= places[place]
            return mix64(np.add.reduceat(values, at) + lens.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null texts are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, end row, bytes, offsets."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = _IN_WORD) -> Words:
    """Words of the texts that ``offsets`` cut from ``data``; ``of`` tells for each byte whether words hold it."""
    inside = of[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = True
    edge[-1] = True
    if len(data):
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[offsets] = True
    cuts = np.flatnonzero(edge)
    runs = inside[cuts[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = cuts[:-1][runs], cuts[1:][runs]
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; as many as there are whole n-grams in the array."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = _GRAM if n <= len(_GRAM) else odd_numbers(n, 3)
    with np.errstate(over="ignore"):
        total = hashes[:count] * factors[0]
        for j in range(1, n):
            total += hashes[j : count + j] * factors[j]
        return mix64(total + U(n))


class Rolled:
    """Rolling n-gram hashes of a word array, of any length: one polynomial hash modulo 2^64 of its beginnings.

    The hash of the ``n`` words from a place on is a difference of two beginnings, moved down by the inverse power of that
    place; a length costs one subtraction and one product, whatever ``n`` is.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * _powers(_BASE, len(hashes)), out=self.sums[1:])
            self.down = _powers(_BASE_INVERSE, len(hashes))

    def grams(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``n`` words from each place on, or from the places ``at`` on."""
        with np.errstate(over="ignore"):
            if at is not None:
                return mix64((self.sums[at + n] - self.sums[at]) * self.down[at] + U(n))
            count = len(self.down) - n + 1
            if count <= 0:
                return np.zeros(0, np.uint64)
            return mix64((self.sums[n:] - self.sums[:count]) * self.down[:count] + U(n))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, out=steps)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place among them of each given one.

    The upper bits of a hash and its position are sorted as one number, which is several times faster than sorting
    positions; runs of different hashes with equal upper bits are put in order afterwards.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int32)
    bits = U(len(keys).bit_length())
    mixed = (keys >> bits << bits) | np.arange(len(keys), dtype=U)
    mixed.sort()
    order = (mixed & ((U(1) << bits) - U(1))).astype(np.int64)
    upper, held = mixed >> bits, keys[order]
    new = np.append(True, held[1:] != held[:-1])
    mixed_up = new[1:] & (upper[1:] == upper[:-1])
    if mixed_up.any():
        for x in np.unique(upper[1:][mixed_up]):
            a, b = np.searchsorted(upper, x), np.searchsorted(upper, x, side="right")
            order[a:b] = order[a:b][np.argsort(held[a:b], kind="stable")]
        held = keys[order]
        new = np.append(True, held[1:] != held[:-1])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new) - 1
    return held[new], place


def gram_hashes_at(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """What ``gram_hashes`` has at some places, in work by their number."""
    factors = _GRAM if n <= len(_GRAM) else odd_numbers(n, 3)
    with np.errstate(over="ignore"):
        total = hashes[starts] * factors[0]
        for j in range(1, n):
            total += hashes[starts + j] * factors[j]
        return mix64(total + U(n))


def gram_places(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams that stay within a text begin, and how many each text has."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    before = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=before[1:])
    return np.arange(int(counts.sum())) + np.repeat(first[:-1] - before, counts), counts
