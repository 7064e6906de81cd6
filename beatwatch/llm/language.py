"""Language of texts by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text is read as segments of bytes, forwards and backwards, with the state set to zero at the ends of
a segment. Every position gets a label distribution from both states; the distributions at letters are
averaged over the whole text. Training is by backpropagation through time over the segments of a bounded sample of
labelled texts, cut at places drawn over their whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.llm.words import chunks

UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and shape of the network.

    ``per_language``: texts of a language, ``pieces``: segments of a text; they bound what each language brings to the
    driver, and every language that is labelled has its share. Training makes ``passes`` over the sample,
    and at least ``steps`` steps.
    """

    per_language: int = 600
    pieces: int = 4
    segment: int = 64
    hidden: int = 8
    passes: int = 6
    steps: int = 250
    batch: int = 256
    rate: float = 0.02
    seed: int = 7
    parts: int = 4
    held: int = 2


@dataclass
class Network:
    """Weights; index 0 of each pair reads forwards, 1 backwards. Rows of gates: update, reset, candidate."""

    names: list[str]
    table: list[np.ndarray] = field(default_factory=list)  # (3H, 256): what a byte adds to the gates
    turn: list[np.ndarray] = field(default_factory=list)  # (3H, H): what the last state adds
    bias: list[np.ndarray] = field(default_factory=list)  # (H, 1): of the candidate's recurrent part
    out: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # (L, 2H)
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))

    @classmethod
    def new(cls, names: list[str], hidden: int, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        return cls(
            names,
            [normal(3 * hidden, 256, scale=0.5) for _ in range(2)],
            [normal(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
            [np.zeros((hidden, 1), np.float32) for _ in range(2)],
            normal(len(names), 2 * hidden, scale=(2 * hidden) ** -0.5),
            np.zeros((len(names), 1), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.turn, *self.bias, self.out, self.out_bias]


def read(net: Network, side: int, text: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, N) of one direction over ``text`` (T, N); ``keep`` collects what training needs."""
    steps, n = text.shape
    h3, hidden = net.turn[side].shape
    states = np.empty((steps, hidden, n), np.float32)
    state = np.zeros((hidden, n), np.float32)
    x = np.empty((h3, n), np.float32)
    u = np.empty((h3, n), np.float32)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        np.take(net.table[side], text[t], axis=1, out=x, mode="clip")
        np.matmul(net.turn[side], state, out=u)
        gates = x[: 2 * hidden]
        gates += u[: 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        back = u[2 * hidden :]
        back += net.bias[side]
        new = x[2 * hidden :]
        if keep is None:
            back *= gates[hidden:]
            new += back
            np.tanh(new, out=new)
        else:
            new += gates[hidden:] * back
            np.tanh(new, out=new)
            keep.append((t, state, gates[:hidden].copy(), gates[hidden:].copy(), back.copy(), new.copy()))
        # state = (1 - update) * candidate + update * last state
        np.subtract(state, new, out=states[t])
        states[t] *= gates[:hidden]
        states[t] += new
        state = states[t]
    return states


def label(net: Network, text: np.ndarray) -> np.ndarray:
    """Label probabilities (T, L, N) of every position of ``text`` (T, N)."""
    hidden = net.turn[0].shape[1]
    ahead, back = read(net, 0, text), read(net, 1, text)
    scores = np.matmul(net.out[:, :hidden], ahead)
    scores += np.matmul(net.out[:, hidden:], back)
    scores += net.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, text: np.ndarray, lang: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the masked positions, and its gradient by backpropagation through time."""
    steps, n = text.shape
    hidden = net.turn[0].shape[1]
    kept: list[list] = [[], []]
    states = [read(net, side, text, kept[side]) for side in (0, 1)]
    scores = np.matmul(net.out[:, :hidden], states[0]) + np.matmul(net.out[:, hidden:], states[1]) + net.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    total = max(1, int(mask.sum()))
    picked = scores[:, lang, np.arange(n)]
    loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
    scores[:, lang, np.arange(n)] -= 1
    scores *= (mask / np.float32(total))[:, None, :]
    grads = [np.zeros_like(w) for w in net.weights()]
    grads[6] = np.concatenate([np.einsum("tln,thn->lh", scores, s, optimize=True) for s in states], axis=1).astype(np.float32)
    grads[7] = scores.sum(axis=(0, 2))[:, None]
    for side in (0, 1):
        from_out = np.matmul(net.out[:, side * hidden : (side + 1) * hidden].T, scores)
        gate_in = np.zeros((steps, 3 * hidden, n), np.float32)
        later = np.zeros((hidden, n), np.float32)
        for t, last, update, reset, back, new in reversed(kept[side]):
            d = from_out[t] + later
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (last - new) * update * (1 - update)
            d_reset = d_new * back * reset * (1 - reset)
            d_back = d_new * reset
            gate_in[t] = np.concatenate([d_update, d_reset, d_new])
            into = np.concatenate([d_update, d_reset, d_back])
            grads[2 + side] += into @ last.T
            grads[4 + side] += d_back.sum(axis=1, keepdims=True)
            later = d * update + net.turn[side].T @ into
        flat = text.ravel()
        for row in range(3 * hidden):
            grads[side][row] = np.bincount(flat, weights=gate_in[:, row].ravel(), minlength=256)
    return loss, grads


def train(names: list[str], text: np.ndarray, lang: np.ndarray, mask: np.ndarray, settings: Settings) -> Network:
    """Adam over shuffled batches of segments; ``text`` (T, N), ``lang`` (N,), ``mask`` (T, N)."""
    net = Network.new(names, settings.hidden, settings.seed)
    draw = np.random.default_rng(settings.seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    n = text.shape[1]
    steps = max(settings.steps, -(-settings.passes * n // settings.batch))
    waiting = np.zeros(0, np.int64)
    for turn in range(1, steps + 1):
        if len(waiting) < min(settings.batch, n):
            waiting = draw.permutation(n)
        at, waiting = waiting[: settings.batch], waiting[settings.batch :]
        _, grads = gradients(net, text[:, at], lang[at], mask[:, at])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = settings.rate * (1 - 0.9 * turn / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g * np.float32(min(1.0, 1.0 / (size + 1e-9)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate / (1 - 0.9**turn) * m / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (T, N) and letter mask (T, N) of all segments of the texts, and the first segment of each text.

    The last segment of a text is filled with blanks, which are no letters.
    """
    counts = -(-np.diff(offsets) // length)
    first = np.concatenate(([0], np.cumsum(counts)))
    starts = np.repeat(offsets[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * length
    ends = np.minimum(starts + length, np.repeat(offsets[1:], counts))
    at = starts[None, :] + np.arange(length)[:, None]
    inside = at < ends[None, :]
    raw = np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(0x20)) if len(data) else np.zeros((length, 0), np.uint8)
    return _LOWER[raw], _LETTER[raw].astype(np.float32), first


def _pieces(docs: DataFrame, settings: Settings) -> DataFrame:
    """Some segments of each text, at places drawn from the doc_id over the whole length."""
    length = settings.segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                raw = text.encode()
                draw = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
                count = max(1, min(settings.pieces, len(raw) // length))
                rows += [(lang, raw[a : a + length].ljust(length)) for a in draw.integers(0, max(1, len(raw) - length + 1), count).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "piece"])

    return docs.mapInArrow(run, "lang string, piece binary")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Network | None:
    """A network from a bounded sample of ``doc_id, text, lang``; None if nothing is labelled.

    The sample takes about ``per_language`` texts of each language by a hash of doc_id and text; segments are ordered by
    a hash as well, so the network is the same in every run.
    """
    known = labelled.filter("lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, settings.per_language / r["count"]))])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), 11) / F.lit(float(1 << 53))
    sample = known.filter(place < F.try_element_at(share, F.col("lang")))
    most = 2 * settings.per_language * len(counts) * settings.pieces
    rows = _pieces(sample, settings).orderBy(F.xxhash64("piece", "lang")).limit(most).toArrow()
    names = sorted(r["lang"] for r in counts)
    code = {name: i for i, name in enumerate(names)}
    raw = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8).reshape(-1, settings.segment).T
    lang = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
    return train(names, np.ascontiguousarray(_LOWER[raw]), lang, _LETTER[raw].astype(np.float32), settings)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Mean label probabilities over the letters of each text; rows of zeros where there are none."""
    text, mask, first = segments(data, offsets, length)
    sums = np.zeros((len(offsets) - 1, len(net.names)))
    if text.shape[1]:
        found = label(net, text)
        by_piece = np.einsum("tln,tn->nl", found, mask)
        some = np.flatnonzero(np.diff(first))
        sums[some] = np.add.reduceat(by_piece, first[some], axis=0)
        letters = np.zeros(len(sums))
        letters[some] = np.add.reduceat(mask.sum(axis=0), first[some])
        sums /= np.maximum(letters, 1)[:, None]
    return sums


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, from nothing but its text.

    Texts that are null or have no letter are ``und`` with score 0, and so are all without a network.
    Rows that share a doc_id are read each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for row, end, data, offsets in chunks(column, 1 << 18):
                size = end - row
                names, score = np.full(size, UNKNOWN, object), np.zeros(size)
                if net is not None:
                    letters = np.array([t is not None and _has_letter(t) for t in column.slice(row, size).to_pylist()])
                    found = pooled(net, data, offsets, settings.segment)
                    best = found.argmax(axis=1)
                    names[letters] = np.array(net.names, object)[best[letters]]
                    score[letters] = np.clip(found[letters, best[letters]], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, size), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(settings: Settings = Settings()) -> Column:
    """Whether the crc32 of the doc_id's decimal text leaves the held-out remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.parts == settings.held, F.lit(False))
