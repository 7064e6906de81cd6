"""Token ids of texts by a tokenizer that is asked once for each distinct piece.

A byte-level BPE tokenizer splits a text by a pattern before it merges. Texts are cut here only where that
pattern always splits, whatever stands on either side: before a blank that follows a visible
character, between an ASCII letter and ASCII punctuation, and after a single line feed before a visible
character. So the ids of a text are those of its pieces in a row, and a piece needs encoding once.

The added tokens of a tokenizer are taken out of a text before it is split. Each is a piece of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from beatwatch.llm.words import mix64, odd_numbers

MOST_PIECES = 2_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# an apostrophe may open a contraction and is left where it is
_POINT = np.zeros(256, bool)
_POINT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_BYTE = odd_numbers(256, 21)
_PLACE = odd_numbers(1 << 12, 22)


def places_of(tokens: Sequence[bytes], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Where ``tokens`` begin and end in the texts: the first, of those the longest, then on behind it."""
    raw = data.tobytes()
    if not any(t in raw for t in tokens):
        return []
    any_token = re.compile(b"|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)))
    return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in any_token.finditer(raw, a, b)]


def piece_starts(data: np.ndarray, offsets: np.ndarray, tokens: Sequence[bytes] = ()) -> np.ndarray:
    """Where pieces begin; no piece reaches over the end of a text, and each of the ``tokens`` is one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # the end of a visible character: ASCII, or two bytes from U+00C0 to U+00FF, none of which is a blank
    seen = _VISIBLE[data]
    seen[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    cut = np.zeros(n, bool)
    cut[1:] = (_BLANK[data[1:]] & seen[:-1]) | (_LETTER[data[:-1]] & _POINT[data[1:]])
    opens = _VISIBLE[data] | (data == 0xC3)
    cut[2:] |= (data[1:-1] == 0x0A) & seen[:-2] & opens[2:]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    for a, b in places_of(tokens, data, offsets):
        cut[a:b] = False
        cut[[a, b] if b < n else a] = True
    # a blank that opens a text does not follow the text before it; the cut is there anyway
    return np.flatnonzero(cut)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lens = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lens)
    places = _PLACE if lens.max() <= len(_PLACE) else odd_numbers(int(lens.max()), 22)
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(_BYTE[data] * places[place], starts) + lens.astype(np.uint64))


class PieceIds:
    """Ids of pieces seen by this process, at most ``most`` of them besides those of the current call.

    ``tokens`` are the strings that ``encode`` takes out of a text before it splits it.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = MOST_PIECES, tokens: Sequence[bytes] = ()) -> None:
        self.encode, self.most, self.tokens = encode, most, tokens
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        found = self.encode([raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())])
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum()))])
        keys, at, count = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.count, count])
        order = np.argsort(keys)
        self.keys, self.at, self.count = keys[order], at[order], count[order]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of the first id of each text."""
        starts = piece_starts(data, offsets, self.tokens)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        kinds, one, place = np.unique(piece_hashes(data, starts), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        where = np.searchsorted(self.keys, kinds)
        known = np.zeros(len(kinds), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == kinds[inside]
        if not known.all():
            new = one[~known]
            self._learn(data, starts[new], np.append(starts[1:], len(data))[new], kinds[~known])
            where = np.searchsorted(self.keys, kinds)
        count, at = self.count[where][place], self.at[where][place]
        after = np.cumsum(count)
        ids = self.ids[np.arange(int(after[-1])) + np.repeat(at - (after - count), count)]
        first = np.concatenate(([0], after))[np.searchsorted(starts, offsets)]
        return ids, first
