"""Scores of texts under a probabilistic suffix tree learned from the corpus.

Symbols are lower-cased words and one end mark a text. A context of one word up to ``Settings.depth`` words
is a state if its next-word distribution differs from that of its suffix: the gain in log likelihood over all
of its occurrences, each predicted without itself, must reach a threshold. A state's distribution is smoothed
with that of its longest suffix that is a state, down to the empty context; a word is scored by the longest
suffix of its history that is a state.

Depths are found one after the other. A round asks which contexts of its depth are states, and at the same time
counts the n-grams that the next depth needs: those whose context training texts have often enough. Texts
without long passages in common ask for next to nothing in the deeper rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.llm import blocks as B
from beatwatch.llm.words import distinct, find_words, gram_hashes, gram_hashes_at, mix64
from beatwatch.session import shared_dir

# questions: counts of n-grams have stage n, gains of contexts of n words stage GAINS + n
GAINS = 1 << 16
END = mix64(np.array([0x656E64], np.uint64))[0]
NULL_ID = -(1 << 63)
# n-grams that repeat within a block are asked for once, so larger blocks ask less; a task holds some 15 times this
BLOCK_BYTES = 16 << 20
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_states long"


@dataclass(frozen=True)
class Settings:
    """``depth``: words of the longest contexts; ``least``: occurrences that a context needs; ``gain``: nats that it must save;
    ``pull``: weight of the suffix's distribution by depth, the last one for all deeper contexts."""

    depth: int = 5
    least: int = 4
    gain: float = 3.0
    pull: tuple[float, ...] = (1000.0, 5.0)
    parts: int = 5
    held: int = 1


def held_out(ids: np.ndarray, parts: int, held: int) -> np.ndarray:
    """crc32 of the decimal doc_id modulo ``parts`` is ``held``; a null doc_id has an empty text."""
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % parts == held for i in ids.tolist()], bool)


def pack_tokens(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Token offsets, and as body: count of kinds, their hashes by falling frequency, byte planes of each token's rank."""
    words = find_words(data, offsets)
    first = words.first + np.arange(len(words.first))
    tokens = np.full(int(first[-1]), END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[first[1:] - 1] = False
    tokens[inside] = words.hashes(lower=True)
    kinds, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    planes = rank[at].view(np.uint8).reshape(-1, 4).T
    return first, np.int64(len(kinds)).tobytes() + kinds[order].tobytes() + planes.tobytes()


def unpack_tokens(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the kinds, and the kind of each token."""
    count = int(body[:8].view(np.int64)[0])
    ranked = body[8 : 8 + 8 * count].view(np.uint64)
    order = np.argsort(ranked)
    place = np.empty(count, np.int32)
    place[order] = np.arange(count, dtype=np.int32)
    rank = np.ascontiguousarray(body[8 + 8 * count :].reshape(4, -1).T).view(np.uint32).ravel()
    return ranked[order], place[rank]


@dataclass
class Grams:
    """Sorted keys of n-grams, the key of the n-gram that ends at each position (-1: none asked for), counts in training texts.

    ``counts`` has a 0 more at its end, which is what -1 picks.
    """

    keys: np.ndarray
    place: np.ndarray
    counts: np.ndarray | None = None

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.counts[self.place[positions]]


class Walk:
    """The texts of a block, read with the states of one depth after the other.

    ``context`` holds the n-grams of the present depth, ``longer`` those of one word more.
    """

    def __init__(self, row: dict, settings: Settings, buckets: int) -> None:
        self.settings, self.buckets, self.block = settings, buckets, row["block"]
        self.ids, self.first, body = B.unpack(row)
        self.kinds, self.token = unpack_tokens(body)
        self.held = held_out(self.ids, settings.parts, settings.held)
        lens = np.diff(self.first)
        self.train = np.repeat(~self.held, lens)
        self.before = np.arange(len(self.token), dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), lens)
        self.hashes = self.kinds[self.token]
        self.depth, self.may = 1, None
        self.context = Grams(self.kinds, self.token)
        self.longer = self.grams(np.flatnonzero(self.before >= 1), 2)

    def grams(self, ends: np.ndarray, n: int) -> Grams:
        """The n-grams that end at some positions."""
        place = np.full(len(self.token), -1, np.int32)
        if 2 * len(ends) > len(self.token):
            found = gram_hashes(self.hashes, n)[ends - (n - 1)]
        else:
            found = gram_hashes_at(self.hashes, ends - (n - 1), n)
        keys, place[ends] = distinct(found)
        return Grams(keys, place)

    def ask_counts(self, grams: Grams, n: int) -> pa.RecordBatch:
        own = np.bincount(grams.place[self.train & (grams.place >= 0)], minlength=len(grams.keys))
        return B.ask(self.block, grams.keys, self.buckets, lambda at: B.pack_numbers(own[at], np.uint32), n)

    def read_counts(self, grams: Grams, n: int, got: dict[int, bytes]) -> None:
        grams.counts = np.append(B.read_numbers(got, B.split(grams.keys, self.buckets), len(grams.keys), np.uint32, n), np.uint32(0))

    def start(self, got: dict[int, bytes], n: int, v: int) -> None:
        """Read the counts of words and pairs; ``p`` is how likely each token is in the states so far, ``base`` in no context."""
        self.read_counts(self.context, 1, got)
        self.read_counts(self.longer, 2, got)
        self.known = (self.context.counts > 0)[self.token]
        self.base = ((self.context.counts + 0.5) / (n + 0.5 * (v + 1)))[self.token]
        self.p, self.deep = self.base.copy(), np.zeros(len(self.token), bool)

    def following(self, grams: Grams, positions: np.ndarray) -> np.ndarray:
        """Of some positions, those that follow an n-gram that may be a state."""
        often = grams.counts >= self.settings.least
        return positions[often[grams.place[positions - 1]]]

    def contexts(self) -> np.ndarray:
        """Positions whose context may be a state."""
        if self.may is None:
            self.may = self.following(self.context, np.flatnonzero(self.before >= self.depth))
        return self.may

    def odds(self, at: np.ndarray, without: int) -> np.ndarray:
        """How likely the words at some positions are in their contexts, with ``without`` of their own occurrences left out."""
        pull = self.settings.pull[min(self.depth, len(self.settings.pull)) - 1]
        follow = np.maximum(self.longer.at(at).astype(np.float64) - without, 0)
        return (follow + pull * self.p[at]) / (self.context.at(at - 1) + (pull - without))

    def ask_gains(self) -> pa.RecordBatch:
        may = self.contexts()
        place = self.context.place[may - 1]
        own = may[self.train[may]]
        gain = np.bincount(self.context.place[own - 1], weights=np.log(self.odds(own, 1) / self.p[own]), minlength=len(self.context.keys))
        some = self.present(place)
        return B.ask(self.block, self.context.keys[some], self.buckets, lambda at: B.pack_numbers(gain[some[at]], np.float32), GAINS + self.depth)

    def present(self, place: np.ndarray) -> np.ndarray:
        used = np.zeros(len(self.context.keys), bool)
        used[place] = True
        return np.flatnonzero(used)

    def next_grams(self) -> Grams:
        """The n-grams that the next depth needs: their context may be a state, and training texts have what follows its first word."""
        # a context of this depth is in each longer one
        may = self.contexts()
        ends = self.following(self.longer, may[self.before[may] > self.depth])
        return self.grams(ends[self.longer.at(ends) > 0], self.depth + 2)

    def deepen(self, got: dict[int, bytes]) -> None:
        """Use the states of this depth, and go on to the next if there is one."""
        may = self.contexts()
        place = self.context.place[may - 1]
        some = self.present(place)
        gain = np.zeros(len(self.context.keys), np.float32)
        gain[some] = B.read_numbers(got, B.split(self.context.keys[some], self.buckets), len(some), np.float32, GAINS + self.depth)
        state = may[(gain >= self.settings.gain)[place]]
        self.p[state] = self.odds(state, 0)
        self.deep[state] = True
        if self.depth < self.settings.depth:
            longest = self.next_grams()
            self.read_counts(longest, self.depth + 2, got)
            self.context, self.longer, self.depth = self.longer, longest, self.depth + 1
            # the next contexts are among these positions
            self.may = self.following(self.context, may[self.before[may] >= self.depth])


def merge(stage: int, keys: list[np.ndarray], extras: list[bytes]) -> tuple[list[bytes], int, int]:
    """Sums of counts or of gains; for single words also how many tokens and kinds there are."""
    kind = np.uint32 if stage < GAINS else np.float32
    values = np.concatenate([B.unpack_numbers(e, len(k), kind) for k, e in zip(keys, extras)])
    _, place = distinct(np.concatenate(keys))
    sums = np.bincount(place, weights=values)
    cut = np.cumsum([0, *map(len, keys)])
    replies = [B.pack_numbers(sums[place[a:b]], kind) for a, b in zip(cut[:-1], cut[1:])]
    return replies, int(sums.sum()) if stage == 1 else 0, int((sums > 0).sum()) if stage == 1 else 0


def score_texts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``SCORES`` of every document; scores are log10 probabilities of the whole text with its end mark.

    ``n_states`` is the number of positions scored by a state other than the empty context. A null or
    empty text is its end mark alone. Rows that share a doc_id are scored each; an empty table gives no
    rows; other columns are ignored. With nothing to learn from, all words are unknown.

    Counts stay in hash buckets; a block of texts learns the counts of its own n-grams only, so no task
    and no broadcast holds the model.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "suffix_tree")
    blocks = B.write_blocks(docs, f"{where}/blocks", BLOCK_BYTES, pack_tokens)
    buckets, number = B.counts(blocks)
    s = settings

    def ask_words(row: dict) -> Iterator[pa.RecordBatch]:
        walk = Walk(row, s, buckets)
        yield walk.ask_counts(walk.context, 1)
        yield walk.ask_counts(walk.longer, 2)

    with B.dropping_shuffles(spark):
        B.answers(B.on_blocks(blocks, ask_words, B.ASK), merge, buckets).write.parquet(f"{where}/words")
    replies = spark.read.parquet(f"{where}/words")
    totals = replies.agg(F.sum("total"), F.sum("kinds")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)

    def at_depth(row: dict, got: dict[int, bytes], depth: int) -> Walk:
        """A block with the states of all contexts shorter than ``depth`` in use."""
        walk = Walk(row, s, buckets)
        walk.start(got, n, v)
        for _ in range(1, depth):
            walk.deepen(got)
        return walk

    def round_of(depth: int):
        def ask(row: dict, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            walk = at_depth(row, got, depth)
            yield walk.ask_gains()
            if depth < s.depth:
                yield walk.ask_counts(walk.next_grams(), depth + 2)

        return ask

    for depth in range(1, s.depth + 1):
        with B.dropping_shuffles(spark):
            B.answers(B.with_answers(blocks, replies, round_of(depth), B.ASK, number), merge, buckets).write.parquet(f"{where}/depth{depth}")
        replies = replies.union(spark.read.parquet(f"{where}/depth{depth}"))

    def scored(row: dict, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        w = at_depth(row, got, s.depth)
        if s.depth:
            w.deepen(got)

        def by_doc(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, w.first[:-1]) if len(values) else np.zeros(0, values.dtype)

        size = len(w.ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(w.ids, mask=w.ids == NULL_ID), pa.array(w.held), pa.array(np.diff(w.first)), pa.array(by_doc(w.known.astype(np.int64))),
                pa.array(np.full(size, n)), pa.array(by_doc(np.log10(w.base))), pa.array(by_doc(np.log10(w.p))), pa.array(by_doc(w.deep.astype(np.int64))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_states"],
        )

    return B.with_answers(blocks, replies, scored, SCORES, number)
