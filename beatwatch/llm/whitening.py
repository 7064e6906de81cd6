"""Whitening of vectors by the leading eigenpairs of their covariance, found by Jacobi-Davidson iterations.

The covariance is never formed. Vectors are whole numbers ``floor(256 * entry)``; each distinct one is written once, as
blocks of packed rows, and a step of the iteration is one Spark job over the blocks: centred rows times a few
directions and back, summed by Spark to one number for each dimension and direction. The driver holds only such
directions, some dozens of vectors of the table's width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.session import shared_dir

SCALE = 256
BLOCK_BYTES = 4 << 20
# entries of a slice of rows that is held as doubles
SLICE = 1 << 19
_WIDTHS = np.array([1, 2, 4, 8])
_LIMIT = 1 << 63
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Settings:
    """``components``: eigenpairs asked for; ``guard``: pairs below them that are corrected as well, as one job serves all;
    ``start`` and ``most``: directions of the subspace at first and before a restart; ``inner``: MINRES steps
    of a correction at most; ``rounds``: expansions at most."""

    components: int = 4
    guard: int = 8
    start: int = 20
    most: int = 48
    inner: int = 4
    rounds: int = 200
    seed: int = 12


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept rows of a list column, their entries as whole numbers in a row, and where each row's entries begin.

    A row is kept if it is not null and has no null or non-finite entry. Entries beyond a long stay at its ends.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    bad = ~column.is_valid().to_numpy(zero_copy_only=False)
    bad[row[~np.isfinite(values)]] = True
    kept = np.flatnonzero(~bad)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[~bad[row]] * SCALE)
    inside = np.abs(scaled) < _LIMIT
    x = np.where(inside, scaled, 0).astype(np.int64)
    if not inside.all():
        x[~inside] = np.where(scaled[~inside] > 0, _LIMIT - 1, -_LIMIT)
    return kept, x, np.concatenate(([0], np.cumsum(sizes[kept])))


def matrix(x: np.ndarray, first: np.ndarray, dims: int) -> np.ndarray:
    """Rows of ``dims`` entries; shorter ones are filled with zeros."""
    sizes = np.diff(first)
    if len(sizes) and (sizes == dims).all():
        return x.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(x)) - np.repeat(first[:-1], sizes)
    out[row[place < dims], place[place < dims]] = x[place < dims]
    return out


def pack(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary for each row, equal for equal rows: entry width, then entries without the zeros at the end."""
    count = len(first) - 1
    row = np.repeat(np.arange(count), np.diff(first))
    place = np.arange(len(x)) - first[:-1][row]
    sizes = np.zeros(count, np.int64)
    np.maximum.at(sizes, row[x != 0], place[x != 0] + 1)
    stays = place < sizes[row]
    x, row, place = x[stays], row[stays], place[stays]
    # bits besides the sign
    bits = np.where(x < 0, ~x, x)
    need = (bits >= 1 << 7).astype(np.int64) + (bits >= 1 << 15) + (bits >= 1 << 31)
    kind = np.zeros(count, np.int64)
    np.maximum.at(kind, row, need)
    width = _WIDTHS[kind]
    ends = np.concatenate(([0], np.cumsum(1 + sizes * width)))
    body = np.zeros(int(ends[-1]), np.uint8)
    body[ends[:-1]] = width
    at = ends[:-1][row] + 1 + place * width[row]
    for byte in range(int(width.max(initial=0))):
        has = width[row] > byte
        body[at[has] + byte] = (x[has] >> (8 * byte)) & 255
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of packed rows one after another, and where each row's begin."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    width = body[ends[:-1]].astype(np.int64)
    sizes = (np.diff(ends) - 1) // width
    first = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = ends[:-1][row] + 1 + (np.arange(int(first[-1])) - first[:-1][row]) * width[row]
    x = np.zeros(len(at), np.int64)
    for byte in range(int(width.max(initial=0))):
        has = width[row] > byte
        x[has] |= body[at[has] + byte].astype(np.int64) << (8 * byte)
    shift = 64 - 8 * width[row]
    return (x << shift) >> shift, first


BLOCK = "n_rows long, dims int, width int, body binary"


def fit_blocks(vectors: DataFrame, column: str, where: str) -> DataFrame:
    """Each distinct vector once, in blocks of some ``BLOCK_BYTES``, written to ``where``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, first = whole_numbers(batch.column(0))
            yield pa.RecordBatch.from_arrays([pack(x, first).cast(pa.binary())], names=["x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first = unpack(batch.column(0))
            rows = matrix(x, first, int(np.diff(first).max(initial=0)))
            step = max(1, BLOCK_BYTES // max(1, 8 * rows.shape[1]))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                width = next(w for w in _WIDTHS.tolist() if w == 8 or (part >> (8 * w - 1) == part >> 63).all())
                row = [[len(part)], [part.shape[1]], [width], [part.astype(f"i{width}").tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["n_rows", "dims", "width", "body"]
                )

    found = vectors.select(column).mapInArrow(keys, "x binary").distinct()
    found.mapInArrow(blocks, BLOCK).write.parquet(where)
    return vectors.sparkSession.read.parquet(where)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["body"], f"i{row['width']}").reshape(row["n_rows"], row["dims"])


def sums(blocks: DataFrame, dims: int) -> list[int]:
    """Exact sums of the entries of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for rows in _block_rows(batches):
            # halves are summed apart, so that no sum of longs runs over
            x = rows.astype(np.int64)
            total[: x.shape[1]] += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], names=["i", "s"])

    found = blocks.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * dims
    for r in found:
        out[r["i"]] = int(r["s"])
    return out


def centred(blocks: DataFrame, mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of what ``work`` makes of slices of centred rows, an array of ``shape``."""
    dims, step = len(mean), max(1, SLICE // max(1, len(mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        held = np.empty((step, dims))
        for rows in _block_rows(batches):
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                x = held[: len(part)]
                x[:, part.shape[1] :] = 0
                x[:, : part.shape[1]] = part
                x -= mean
                total += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "y"])

    parts = blocks.mapInArrow(run, "i int, y array<double>")
    found = parts.groupBy("i").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(shape[1])]).collect()
    out = np.zeros(shape)
    for r in found:
        out[r["i"]] = r[1:]
    return out


Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, right: np.ndarray, steps: int, within: float) -> np.ndarray:
    """Near solutions of ``product(t) = right`` for all columns side by side, the product being symmetric.

    Every step asks for one product of all columns; it ends when no column's residual is above ``within`` of its start.
    """
    size = np.linalg.norm(right, axis=0)
    safe = lambda v: np.where(v > 0, v, 1)
    out = np.zeros_like(right)
    v, v_last = right / safe(size), np.zeros_like(right)
    w, w_last = np.zeros_like(right), np.zeros_like(right)
    c = c_last = np.ones(len(size))
    s = s_last = np.zeros(len(size))
    link, left = np.zeros(len(size)), size.copy()
    for _ in range(steps):
        p = product(v)
        a = (v * p).sum(axis=0)
        p = p - a * v - link * v_last
        new = np.linalg.norm(p, axis=0)
        delta = c * a - c_last * s * link
        rho1, rho2, rho3 = np.hypot(delta, new), s * a + c_last * c * link, s_last * link
        rho1 = safe(rho1)
        c_last, s_last, c, s = c, s, delta / rho1, new / rho1
        w_last, w = w, (v - rho3 * w_last - rho2 * w) / rho1
        out += c * left * w
        left = -s * left
        v_last, v, link = v, p / safe(new), new
        if (np.abs(left) <= within * size).all():
            break
    return out


def _orthogonal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``new`` has outside of ``against``; negligible ones are left out."""
    base = np.concatenate(against, axis=1) if against else np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - base @ (base.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            base = np.concatenate([base, column[:, None]], axis=1)
    return base[:, sum(a.shape[1] for a in against) :]


def leading_pairs(product: Product, dims: int, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns, to double precision.

    Jacobi-Davidson on a subspace with Rayleigh-Ritz: all pairs that are still open get a correction at once, by a few
    MINRES steps on the equation projected off the locked vectors and the present ones. A pair is locked when its
    residual, by a product of its own, is down to rounding: below 32 machine epsilons of the largest eigenvalue, or no longer
    falling and below 1e-12 of it.
    """
    wanted = min(settings.components, dims)
    most = min(dims, max(settings.most, settings.start + 2 * (wanted + settings.guard)))
    draw = np.random.default_rng(settings.seed)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = _orthogonal(draw.normal(size=(dims, min(dims, max(settings.start, wanted)))))
    image = product(space)
    best, stuck = np.inf, 0
    for _ in range(settings.rounds):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        k = min(wanted - len(values), space.shape[1])
        now, after = space @ turn[:, :k], image @ turn[:, :k]
        off = lambda y: y - locked @ (locked.T @ y)
        rest = off(after - now * ritz[:k])
        size = np.linalg.norm(rest, axis=0)
        top = max(ritz[0], values.max(initial=0.0))
        if top <= 0:
            break
        stuck = stuck + 1 if size.max() > best / 2 else 0
        best = min(best, size.max())
        near = size <= (1e-12 if stuck >= 3 or space.shape[1] + len(values) >= dims else 32 * EPS) * top
        if near.any():
            # by a product of its own, as images are carried through restarts
            own = _orthogonal(now[:, near], locked)
            fresh = product(own)
            value = (own * fresh).sum(axis=0)
            true = np.linalg.norm(off(fresh - own * value), axis=0)
            done = true <= (1e-12 if stuck >= 3 or space.shape[1] + len(values) >= dims else 64 * EPS) * top
            if done.any():
                locked, values = np.concatenate([locked, own[:, done]], axis=1), np.concatenate([values, value[done]])
                best, stuck = np.inf, 0
                if len(values) == wanted:
                    break
                keep = np.ones(space.shape[1], bool)
                keep[np.flatnonzero(near)[done]] = False
                space, image = space @ turn[:, keep], off(image @ turn[:, keep])
                if not space.shape[1]:
                    space = _orthogonal(draw.normal(size=(dims, min(wanted, dims - len(values)))), locked)
                    image = off(product(space))
                continue
        k = min(k + settings.guard, space.shape[1])
        now, after, theta = space @ turn[:, :k], image @ turn[:, :k], ritz[:k]
        rest = off(after - now * theta)
        if space.shape[1] + k > most:
            keep = max(settings.start, 2 * k)
            space, image = space @ turn[:, :keep], image @ turn[:, :keep]
        beside = np.concatenate([locked, now], axis=1)
        clear = lambda y: y - beside @ (beside.T @ y)
        within = min(0.3, max(1e-3, 10 * EPS * top / max(size.max(), EPS * top)))
        steps = min(settings.inner, dims - beside.shape[1])
        fix = minres(lambda y: clear(product(clear(y)) - theta * clear(y)), -clear(rest), steps, within)
        new = _orthogonal(fix, locked, space)
        if new.shape[1] < k:
            # a correction inside the subspace brings nothing; the residuals and fresh directions take its place
            new = _orthogonal(np.concatenate([fix, rest, draw.normal(size=(dims, k))], axis=1), locked, space)[:, :k]
        space = np.concatenate([space, new], axis=1)
        if new.shape[1]:
            image = np.concatenate([image, off(product(new))], axis=1)
    else:
        raise RuntimeError("eigenpairs did not settle")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


@dataclass
class Whitening:
    """A fit: rows of the fit list, exact sums of their entries, eigenpairs from the largest on, and what they leave out.

    ``error`` is the largest absolute entry of the whitened fit list's covariance minus the identity.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def whitened(self, centred_rows: np.ndarray) -> np.ndarray:
        return (centred_rows @ self.vectors) / np.sqrt(self.values)


def fit(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> Whitening | None:
    """The whitening of the distinct vectors of ``column``; None where no vector varies.

    Rows whose vector is null or has a null or non-finite entry are left out, shorter vectors are filled with zeros.
    Components without variance, to double precision, are left out.
    """
    blocks = fit_blocks(vectors, column, shared_dir(vectors.sparkSession, "whitening"))
    n, dims = blocks.agg(F.sum("n_rows"), F.max("dims")).first()
    if not n or not dims:
        return None
    found = Whitening(n, sums(blocks, dims), np.zeros(0), np.zeros((dims, 0)), np.zeros(0), 0.0)
    mean = found.mean
    trace = float(centred(blocks, mean, lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), (1, 1))[0, 0]) / n
    if trace <= 0:
        return None
    values, pairs = leading_pairs(lambda v: centred(blocks, mean, lambda x: x.T @ (x @ v), v.shape) / n, dims, settings)
    real = values > dims * EPS * trace
    found.values, found.vectors, found.explained = values[real], pairs[:, real], values[real] / trace
    k = int(real.sum())

    def squares(x: np.ndarray) -> np.ndarray:
        z = found.whitened(x)
        return z.T @ z

    found.error = float(np.abs(centred(blocks, mean, squares, (k, k)) / n - np.eye(k)).max())
    return found


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, found: Whitening | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector and component: place on the component in units of its deviation.

    ``deviation`` is the exact sum of ``(n * x - S) ** 2`` over the dimensions, null beyond 38 digits. Rows whose vector is
    null or holds a null or non-finite entry have no row here; rows that share a key, or have none, are all there, and an
    empty table or one without variance gives no rows. Other columns are ignored.
    """
    if found is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    mean, dims, k = found.mean, len(found.sums), len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SLICE // dims)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                kept, flat, first = whole_numbers(part.column(1))
                rows = matrix(flat, first, dims)
                z = found.whitened(rows - mean)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(kept, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                        pa.array(np.full(k * len(kept), found.n)),
                        deviations(rows, found.n, found.sums).take(pa.array(np.repeat(np.arange(len(kept)), k))),
                        pa.array(z.ravel()),
                        pa.array(np.tile(found.explained, len(kept))),
                        pa.array(np.full(k * len(kept), found.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(key).cast("long"), F.col(column)).mapInArrow(run, WHITENED)


def deviations(rows: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Exact sums of squares of ``n * x - total`` by row, in longs where all fit and in whole numbers of any size else."""
    kind = pa.decimal128(38, 0)
    most = n * int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))) + max(map(abs, total), default=0)
    if len(total) * most * most < _LIMIT:
        off = rows * n - np.array(total, np.int64)
        return pa.array(np.einsum("ij,ij->i", off, off)).cast(kind)
    off = rows.astype(object) * n - np.array(total, object)
    found = (off * off).sum(axis=1).tolist()
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], kind)
