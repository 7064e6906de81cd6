"""Quality of texts by a convolutional network over bytes, trained here in numpy.

A text is read as chunks of bytes that overlap and cover it whole. Learned filters over a few bytes slide along a chunk;
of each filter the highest answer in the chunk stays. A small layer makes one log-odds of these, and the mean
over a text's chunks, scaled by a fit on whole texts, is the log-odds of the text. Training is by backpropagation over
chunks of a bounded sample of labelled texts, drawn over their whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.llm.words import chunks

# bytes of texts that are read at once, overlaps and short texts' filling included
READ_BYTES = 1 << 18


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and shape of the network.

    ``per_label``: labelled texts of a label at most, ``pieces``: chunks of a text at most that are trained on, drawn over
    its length. ``chunk`` and ``overlap`` are bytes. Of the sample, one text in ``check`` is kept out of the
    network's training and sets the scale of the log-odds, by whole texts.
    Training makes ``epochs`` passes over the sample's chunks and at least ``steps`` steps.
    ``threshold``: the score from which a text is predicted good.
    """

    per_label: int = 4000
    pieces: int = 6
    check: int = 5
    chunk: int = 512
    overlap: int = 64
    width: int = 8
    stride: int = 2
    embed: int = 6
    filters: int = 32
    hidden: int = 16
    epochs: int = 8
    steps: int = 600
    batch: int = 128
    rate: float = 0.004
    seed: int = 11
    parts: int = 4
    held: int = 2
    threshold: float = 0.7


@dataclass
class Network:
    """Weights: of bytes, of filters (bytes of a window one after another), of the layer and its output; then the scale."""

    embed: np.ndarray  # (256, E)
    filters: np.ndarray  # (W * E, F)
    filter_bias: np.ndarray  # (F,)
    layer: np.ndarray  # (F, H)
    layer_bias: np.ndarray  # (H,)
    out: np.ndarray  # (H,)
    out_bias: np.ndarray  # (1,)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, s: Settings) -> Network:
        draw = np.random.default_rng(s.seed)
        normal = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
        size = s.width * s.embed
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(
            normal(0.5, 256, s.embed), normal((2 / size) ** 0.5 * 2, size, s.filters), zeros(s.filters),
            normal(s.filters**-0.5, s.filters, s.hidden), zeros(s.hidden), normal(s.hidden**-0.5, s.hidden), zeros(1),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.layer, self.layer_bias, self.out, self.out_bias]


def highest(net: Network, text: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest answer (N, F) of each filter in the chunks ``text`` (N, C), before the cut at 0, and its window."""
    size = net.embed.shape[1]
    width = len(net.filters) // size
    flat = np.ascontiguousarray(net.embed[text]).reshape(len(text), -1)
    windows = np.lib.stride_tricks.sliding_window_view(flat, width * size, axis=1)[:, :: stride * size]
    answers = windows.reshape(-1, width * size) @ net.filters
    answers = answers.reshape(len(text), -1, net.filters.shape[1])
    at = answers.argmax(axis=1)
    return np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + net.filter_bias, at


def odds(net: Network, text: np.ndarray, stride: int) -> np.ndarray:
    """Log-odds of each chunk."""
    size = net.embed.shape[1]
    width = len(net.filters) // size
    flat = np.ascontiguousarray(net.embed[text]).reshape(len(text), -1)
    windows = np.lib.stride_tricks.sliding_window_view(flat, width * size, axis=1)[:, :: stride * size]
    top = np.empty((len(text), net.filters.shape[1]), np.float32)
    for i in range(len(text)):
        (windows[i] @ net.filters).max(axis=0, out=top[i])
    pooled = np.maximum(top + net.filter_bias, 0)
    return np.tanh(pooled @ net.layer + net.layer_bias) @ net.out + net.out_bias[0]


def gradients(net: Network, text: np.ndarray, label: np.ndarray, weight: np.ndarray, stride: int) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross entropy of the chunks, and its gradient; a filter learns from its highest window alone."""
    top, at = highest(net, text, stride)
    pooled = np.maximum(top, 0)
    held = np.tanh(pooled @ net.layer + net.layer_bias)
    logit = held @ net.out + net.out_bias[0]
    share = weight / weight.sum()
    loss = float((share * (np.logaddexp(0, logit) - label * logit)).sum())
    d_logit = (share * (1 / (1 + np.exp(-logit)) - label)).astype(np.float32)
    d_layer = np.outer(d_logit, net.out) * (1 - held * held)
    d_top = (d_layer @ net.layer.T) * (top > 0)
    size = net.embed.shape[1]
    width = len(net.filters) // size
    # the bytes of each filter's window: (N, F, W)
    found = text[np.arange(len(text))[:, None, None], (at * stride)[:, :, None] + np.arange(width)]
    patches = net.embed[found].reshape(len(text), -1, width * size)
    d_filters = np.einsum("nf,nfk->kf", d_top, patches)
    d_embed = np.zeros_like(net.embed)
    into = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, size)
    for e in range(size):
        d_embed[:, e] = np.bincount(found.ravel(), weights=into[:, e], minlength=256)
    return loss, [d_embed, d_filters, d_top.sum(axis=0), pooled.T @ d_layer, d_layer.sum(axis=0), held.T @ d_logit, d_logit.sum(keepdims=True)]


def train(text: np.ndarray, label: np.ndarray, weight: np.ndarray, s: Settings) -> Network:
    """Adam over shuffled batches of chunks ``text`` (N, C): ``epochs`` passes over all, more if those are too few steps."""
    net = Network.new(s)
    draw = np.random.default_rng(s.seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    each = -(-len(text) // s.batch)
    epochs = max(s.epochs, -(-s.steps // each))
    steps, turn = epochs * each, 0
    for _ in range(epochs):
        order = draw.permutation(len(text))
        for a in range(0, len(order), s.batch):
            turn += 1
            at = order[a : a + s.batch]
            _, grads = gradients(net, text[at], label[at], weight[at], s.stride)
            rate = s.rate * (1 - 0.95 * turn / steps)
            for w, g, m, v in zip(net.weights(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate / (1 - 0.9**turn) * m / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


def covering(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of all texts begin, and the first chunk of each text.

    The last chunk ends with its text; texts shorter than a chunk are one, also empty ones.
    """
    room = np.maximum(np.diff(offsets) - s.chunk, 0)
    step = s.chunk - s.overlap
    counts = -(-room // step) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(int(first[-1])) - np.repeat(first[:-1], counts)
    return np.repeat(offsets[:-1], counts) + np.minimum(place * step, np.repeat(room, counts)), first


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int) -> np.ndarray:
    """Chunks (N, C) from ``starts`` on; what lies behind ``ends`` is filled with zero bytes."""
    at = starts[:, None] + np.arange(chunk)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], np.uint8(0))


def text_odds(net: Network, data: np.ndarray, offsets: np.ndarray, s: Settings) -> np.ndarray:
    """Mean log-odds over the chunks of each text, not scaled yet."""
    starts, first = covering(data, offsets, s)
    ends = np.repeat(offsets[1:], np.diff(first))
    step = max(1, READ_BYTES // s.chunk)
    found = np.concatenate([odds(net, cut(data, starts[a : a + step], ends[a : a + step], s.chunk), s.stride) for a in range(0, len(starts), step)]) if len(starts) else np.zeros(0)
    return np.add.reduceat(found.astype(float), first[:-1]) / np.diff(first) if len(first) > 1 else np.zeros(0)


def held_out(s: Settings = Settings()) -> Column:
    """Whether the crc32 of the doc_id's decimal text leaves the held-out remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % s.parts == s.held, F.lit(False))


def _pieces(docs: DataFrame, s: Settings) -> DataFrame:
    """Some chunks of each text, at places drawn from the doc_id over the whole length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                raw = (text or "").encode()
                draw = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
                count = max(1, min(s.pieces, len(raw) // s.chunk))
                rows += [(label, raw[a : a + s.chunk].ljust(s.chunk, b"\0")) for a in draw.integers(0, max(1, len(raw) - s.chunk + 1), count).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "piece"])

    return docs.mapInArrow(run, "label int, piece binary")


def scale(found: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Factor and shift that fit log-odds to labels by Newton steps, drawn a little towards 1 and 0."""
    a = np.array([1.0, 0.0])
    x = np.stack([found, np.ones(len(found))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        slope = x @ (weight * (p - label)) + (a - [1.0, 0.0])
        a = a - np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.eye(2), slope)
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network | None:
    """A network from ``doc_id, text`` and a bounded sample of ``doc_id, label``; None if no labelled text is known.

    Of each label, 0 and 1, about ``per_label`` rows are taken by a hash of the doc_id; a rarer label is weighed as it
    occurs among all. Null labels and ids are left out. Rows are ordered by a hash, so every run gives the same network.
    """
    known = labels.filter("label in (0, 1) and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(label as int) label")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for label, n in sorted(counts.items()) for v in (label, min(1.0, s.per_label / n))])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), "doc_id"), 11) / F.lit(float(1 << 53))
    # some deviations above the share, so the limit is a bound that holds and not a cut
    bound = sum(s.per_label + 10 * int(s.per_label**0.5) + 10 for _ in counts)
    sample = known.filter(place < F.try_element_at(share, "label")).orderBy(place).limit(bound)
    part = F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id"), F.lit(s.check))
    texts = lambda rows: docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(rows), "doc_id")
    most = bound * s.pieces
    rows = _pieces(texts(sample.filter(part > 0)), s).orderBy(F.xxhash64("piece", "label")).limit(most).toArrow()
    if not rows.num_rows:
        rows = _pieces(texts(sample), s).orderBy(F.xxhash64("piece", "label")).limit(most).toArrow()
    if not rows.num_rows:
        return None
    weigh = {label: n / min(n, s.per_label) for label, n in counts.items()}
    label = rows.column("label").to_numpy()
    weight = np.array([weigh[x] for x in label.tolist()])
    text = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8).reshape(-1, s.chunk)
    net = train(text, label.astype(float), weight / weight.mean(), s)
    whole = _odds(texts(sample.filter(part == 0)), net, s, "label int").orderBy("odds", "label").limit(bound).toPandas()
    if len(whole):
        weight = whole["label"].map(weigh).to_numpy(float)
        net.scale = scale(whole["odds"].to_numpy(float), whole["label"].to_numpy(float), weight / weight.mean())
    return net


def _odds(docs: DataFrame, net: Network, s: Settings, keep: str) -> DataFrame:
    """Unscaled log-odds of whole texts beside the column ``keep``."""
    name = keep.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                found = text_odds(net, data, offsets, s)
                yield pa.RecordBatch.from_arrays([batch.column(name).slice(row, end - row), pa.array(found)], names=[name, "odds"])

    return docs.select(name, "text").mapInArrow(run, f"{keep}, odds double")


def score(docs: DataFrame, net: Network | None, s: Settings = Settings()) -> DataFrame:
    """``doc_id, score, predicted`` of every document, from nothing but its whole text.

    Null texts are empty ones, which have a score as well. Without a network every score is 0.5. Rows that share a doc_id,
    or have none, are scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    if net is None:
        found = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        a, b = net.scale
        found = _odds(rows, net, s, "doc_id long").select("doc_id", (1 / (1 + F.exp(-(a * F.col("odds") + b)))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
