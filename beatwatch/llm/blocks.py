"""Documents packed into blocks in doc_id order, and questions that blocks ask of hash buckets.

Some operators need, for every n-gram of a text, what the whole corpus knows of it. Rows for single
n-grams would be many times the corpus, so a block of whole texts asks at once: it sends the sorted
distinct keys that fall into a bucket, a task for each bucket merges the keys of all blocks, and answers
each block in the order of its keys. Blocks and buckets are of bounded size and both grow in number with the
corpus; a key that is in every text is sent once by a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwatch.llm.words import text_bytes

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
BLOCK = "block long, n_bytes long, doc_ids binary, offsets binary, body binary, body_bytes long"
ASK = "bucket long, block long, keys binary, extra binary"
ANSWER = "bucket long, block long, reply binary, total long, kinds long"
# what a null doc_id stands as in a block
NO_ID = -(1 << 63)
# questions of one stage have buckets from stage << STAGE on
STAGE = 32

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let written steps give their shuffle files back at once; for writes whose frame is not used again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


Pack = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, bytes]]


def write_blocks(docs: DataFrame, where: str, size: int = BLOCK_BYTES, pack: Pack | None = None) -> DataFrame:
    """Whole texts in doc_id order, some ``size`` bytes to a block; block numbers ascend with doc_id.

    ``pack`` makes offsets and body from doc_ids, offsets and bytes; without it the texts are kept.

    Null texts are empty ones. Rows of one doc_id stay together, equal ones side by side; a null
    doc_id comes first and is kept as the least long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=1)
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        bodies: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lens)))).astype(np.int64)
            names, body = np.concatenate(ids), b"".join(bodies)
            if pack:
                offsets, body = pack(names, offsets, np.frombuffer(body, np.uint8))
            row = [[number], [held], [names.tobytes()], [offsets.tobytes()], [packer.compress(body)], [len(body)]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, kinds)], names=["block", "n_bytes", "doc_ids", "offsets", "body", "body_bytes"]
            )

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row = 0
            while row < batch.num_rows:
                end = min(batch.num_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + max(1, size - held), side="right")) - 1))
                ids.append(names[row:end].astype(np.int64))
                lens.append(np.diff(offsets[row : end + 1]))
                bodies.append(data[offsets[row] : offsets[end]].tobytes())
                held += len(bodies[-1])
                row = end
                if held >= size:
                    yield block()
                    number, ids, lens, bodies, held = number + 1, [], [], [], 0
        if ids:
            yield block()

    rows = docs.selectExpr(f"coalesce(cast(doc_id as long), {NO_ID}) doc_id", "cast(text as string) text")
    with dropping_shuffles(docs.sparkSession):
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCK).write.option("compression", "none").parquet(where)
    return docs.sparkSession.read.parquet(where)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and bytes of a block row."""
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["body_bytes"]))
    return np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(body, np.uint8)


def counts(blocks: DataFrame, size: int = BUCKET_BYTES) -> tuple[int, int]:
    """How many buckets the texts need, and how many blocks there are; both are one at least."""
    total, number = blocks.agg(F.sum("n_bytes"), F.count("block")).first()
    return max(1, math.ceil((total or 0) / size)), max(1, number)


def split(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Buckets that hold keys, with the places of their sorted distinct keys; the bucket is taken from the scrambled low bits."""
    where = (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % buckets
    # short numbers are sorted by digits
    where = where.astype(np.uint16) if buckets <= 1 << 16 else where
    order = np.argsort(where, kind="stable")
    held, cut = np.unique(where[order], return_index=True)
    return list(zip(held.tolist(), np.split(order, cut[1:])))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, byte planes apart; planes that are all but empty shrink to nothing."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    top = max(0, width - 2)
    return bytes([width]) + planes[:top].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[top:width].tobytes())


def unpack_keys(packed: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint64)
    width = packed[0]
    top = max(0, width - 2)
    planes = np.zeros((8, count), np.uint8)
    planes[:top] = np.frombuffer(packed, np.uint8, top * count, 1).reshape(top, count)
    rest = zstandard.ZstdDecompressor().decompress(packed[1 + top * count :], max_output_size=2 * count)
    planes[top:width] = np.frombuffer(rest, np.uint8).reshape(width - top, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def ask(block: int, keys: np.ndarray, buckets: int, extra: Callable[[np.ndarray], bytes] | None = None, stage: int = 0) -> pa.RecordBatch:
    """The ``ASK`` rows of a block: for each bucket its keys, and what ``extra`` makes of their places."""
    rows: list[tuple] = []
    for b, at in split(keys, buckets):
        rows.append(((stage << STAGE) + b, block, len(at).to_bytes(4, "little") + pack_keys(keys[at]), extra(at) if extra else b""))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["bucket", "block", "keys", "extra"])


def asked(packed: bytes) -> np.ndarray:
    return unpack_keys(packed[4:], int.from_bytes(packed[:4], "little"))


Merge = Callable[[int, list[np.ndarray], list[bytes]], tuple[list[bytes], int, int]]


def answers(asks: DataFrame, merge: Merge, parts: int) -> DataFrame:
    """``ANSWER`` rows of all buckets, which ``parts`` tasks share.

    ``merge`` gets stage, key arrays and extras of a bucket by ascending block; it returns the answers in
    that order and two numbers, which stand on the bucket's first row.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [asked(k) for k in table.column("keys").to_pylist()]
        replies, total, kinds = merge(key[0].as_py() >> STAGE, keys, table.column("extra").to_pylist())
        rest = [0] * (len(replies) - 1)
        numbers = {"total": pa.array([total, *rest], pa.int64()), "kinds": pa.array([kinds, *rest], pa.int64())}
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "reply": pa.array(replies, pa.binary())} | numbers)

    return asks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, ANSWER)


def with_answers(
    blocks: DataFrame, replies: DataFrame, work: Callable[[dict, dict[int, bytes]], Iterator[pa.RecordBatch]], schema: str, parts: int
) -> DataFrame:
    """``work`` on each block with its answers by bucket; ``parts`` tasks share the blocks."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("reply").to_pylist()))
        out = [batch for row in left.to_pylist() for batch in work(row, got)]
        return pa.Table.from_batches(out)

    return blocks.repartition(parts, "block").groupBy("block").cogroup(replies.repartition(parts, "block").groupBy("block")).applyInArrow(run, schema)


def on_blocks(blocks: DataFrame, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in batch.slice(i, 1).to_pylist():
                    yield from work(row)

    return blocks.mapInArrow(run, schema)


def read_bits(replies: dict[int, bytes], places: list[tuple[int, np.ndarray]], count: int, stage: int = 0) -> np.ndarray:
    """One flag for each of ``count`` keys, from the answers of their buckets."""
    out = np.zeros(count, bool)
    for b, at in places:
        out[at] = np.unpackbits(np.frombuffer(replies[(stage << STAGE) + b], np.uint8), count=len(at)).astype(bool)
    return out


def pack_numbers(values: np.ndarray, kind: type) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(kind)).tobytes())


def unpack_numbers(packed: bytes, count: int, kind: type) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, size)), kind)


def read_numbers(replies: dict[int, bytes], places: list[tuple[int, np.ndarray]], count: int, kind: type, stage: int = 0) -> np.ndarray:
    """One number for each of ``count`` keys, from the answers of their buckets."""
    out = np.zeros(count, kind)
    for b, at in places:
        out[at] = unpack_numbers(replies[(stage << STAGE) + b], len(at), kind)
    return out
