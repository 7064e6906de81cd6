"""Token sequences in length-delimited binary records, with an offset index for shuffled reads.

A record file is a row of frames, each of them

    length of the body    8 bytes, little endian
    masked CRC-32 of the length bytes    4 bytes
    body    doc_id (8 bytes), flags (1), bytes to an id (1), ids
    masked CRC-32 of the body    4 bytes

Its index holds the offset of each frame and the end of the file, 8 bytes each. A checksum is
masked by rotation and a constant, since data that hold checksums are prone to fool a plain one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatwatch.llm.blocks import dropping_shuffles
from beatwatch.llm.units import PieceIds
from beatwatch.llm.words import chunks
from beatwatch.session import shared_dir

# fixed values of the frame format
MASK = 0xA282EAD8
END_ID = 0
NULL_DOC = 1

FILE_BYTES = 16 << 20
MANIFEST = "part int, file_no int, file string, n_docs long, n_ids long, n_bytes long"
_ENCODERS: dict[tuple[str, bool], PieceIds] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def frames(data: bytes, at: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Bodies of the frames in ``data``; a broken frame raises."""
    end = len(data) if end is None else end
    while at < end:
        length = data[at : at + 8]
        if len(data) < at + 16 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
            raise ValueError(f"broken frame length at {at}")
        size = struct.unpack("<Q", length)[0]
        body = data[at + 12 : at + 12 + size]
        if len(data) < at + 16 + size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(body):
            raise ValueError(f"broken frame body at {at}")
        yield body
        at += size + 16


def pack_body(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<qBB", doc_id or 0, NULL_DOC if doc_id is None else 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack_body(body: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = struct.unpack_from("<qBB", body)
    return None if flags & NULL_DOC else doc_id, np.frombuffer(body, f"<u{width}", offset=10)


def encoder(path: str, *, added: bool = False) -> PieceIds:
    """The piece encoder of a tokenizer file, one for each worker process.

    With ``added`` the file's added tokens are found in texts, as the tokenizer does if left at its
    defaults; without, their strings are text like any other.
    """
    if (path, added) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added
        tokens = list(tokenizer.get_added_tokens_decoder().values()) if added else []
        if any(t.single_word or t.lstrip or t.rstrip for t in tokens):
            raise ValueError(f"{path}: added tokens that look at what stands beside them")
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _ENCODERS[path, added] = PieceIds(encode, tokens=[t.content.encode() for t in tokens if t.content])
    return _ENCODERS[path, added]


def _store(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where if "://" in where or where.startswith("/") else f"/{where}")


def _put(store: fs.FileSystem, path: str, data: bytes, attempt: int) -> None:
    """Write under a name of this attempt, then move: a repeated task replaces whole files only."""
    with store.open_output_stream(f"{path}.attempt-{attempt}") as out:
        out.write(data)
    store.move(f"{path}.attempt-{attempt}", path)


def write_records(docs: DataFrame, where: str, tokenizer: Callable[[], str], *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts and write record and index files into ``where``/files; returns the manifest.

    Documents stand in ascending doc_id order over the files in (part, file_no) order, null doc_ids
    first, rows of one doc_id by text. A null or empty text is the end id alone. Ids are those of the
    tokenizer at its defaults, so the string of an added token gives that token. ``tokenizer`` names
    the tokenizer file on the machine that calls it. ``where`` must be a folder all executors share.
    """
    spark = docs.sparkSession
    folder = f"{where}/files"
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, path = _store(folder)
        pieces = encoder(tokenizer(), added=True)
        held: list[bytes] = []
        ends: list[int] = [0]
        count, number = 0, 0

        def put() -> pa.RecordBatch:
            name = f"part-{part:07d}-{number:05d}"
            _put(store, f"{path}/{name}.rec", b"".join(held), attempt)
            _put(store, f"{path}/{name}.idx", np.array(ends, "<u8").tobytes(), attempt)
            row = [[part], [number], [f"{name}.rec"], [len(held)], [count], [ends[-1]]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["part", "file_no", "file", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for row, end, data, offsets in chunks(batch.column("text"), 4 << 20):
                ids, first = pieces.texts(data, offsets)
                for d in range(end - row):
                    own = np.append(ids[first[d] : first[d + 1]], END_ID)
                    held.append(frame(pack_body(names[row + d], own)))
                    ends.append(ends[-1] + len(held[-1]))
                    count += len(own)
                    if ends[-1] >= file_bytes:
                        yield put()
                        held, ends, count, number = [], [0], 0, number + 1
        if held:
            yield put()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    with dropping_shuffles(spark):
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{where}/manifest")
    return spark.read.parquet(f"{where}/manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """``file, file_start``: ids in the files before. Sums go by part first, so no task sees all files."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return files.join(parts, "part").select("file", (F.col("part_start") + F.col("in_part")).alias("file_start"))


def read_records(spark: SparkSession, where: str, *, digest: bool = False) -> DataFrame:
    """``file, record, doc_id, ids, file_ids_before`` of every frame, checksums checked, files read by Spark.

    With ``digest`` the ids stay in the task and ``n_ids`` and ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit numbers) take their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name, before, rows = path.rsplit("/", 1)[-1], 0, []
                for number, body in enumerate(frames(content.as_buffer().to_pybytes())):
                    doc_id, ids = unpack_body(body)
                    rows.append((doc_id, ids, before, number))
                    before += len(ids)
                    if len(rows) == 500:
                        yield _rows(name, rows, digest)
                        rows = []
                if rows:
                    yield _rows(name, rows, digest)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(f"{where}/files").select("path", "content")
    held = "n_ids long, ids_crc32 long" if digest else "ids array<int>"
    return files.mapInArrow(run, f"file string, record long, doc_id long, {held}, file_ids_before long")


def _rows(name: str, rows: list[tuple], digest: bool = False) -> pa.RecordBatch:
    columns = {"file": pa.array([name] * len(rows)), "record": pa.array([r[3] for r in rows], pa.int64()), "doc_id": pa.array([r[0] for r in rows], pa.int64())}
    if digest:
        columns["n_ids"] = pa.array([len(r[1]) for r in rows], pa.int64())
        columns["ids_crc32"] = pa.array([zlib.crc32(r[1].astype("<u4").tobytes()) for r in rows], pa.int64())
    else:
        ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[1].astype(np.int32) for r in rows])))
    columns["file_ids_before"] = pa.array([r[2] for r in rows], pa.int64())
    return pa.RecordBatch.from_pydict(columns)


def read_shuffled(spark: SparkSession, where: str, seed: int) -> DataFrame:
    """``doc_id, ids`` of all records in a random order of ``seed``, each fetched by its offset in the index."""
    folder = f"{where}/files"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                cuts = np.frombuffer(content, "<u8").astype(np.int64)
                name = path.rsplit("/", 1)[-1].removesuffix(".idx") + ".rec"
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(cuts) - 1)), pa.array(cuts[:-1]), pa.array(cuts[1:])], names=["file", "start", "stop"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            rows = []
            for name, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop"))):
                with store.open_input_file(f"{path}/{name}") as source:
                    doc_id, ids = unpack_body(next(frames(source.read_at(stop - start, start))))
                rows.append((doc_id, ids, 0, 0))
            if rows:
                yield _rows("", rows).select(["doc_id", "ids"])

    index = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select("path", "content")
    order = index.mapInArrow(entries, "file string, start long, stop long").orderBy(F.xxhash64(F.lit(seed), "file", "start"))
    return order.mapInArrow(fetch, "doc_id long, ids array<int>")


def encoded_documents(docs: DataFrame, tokenizer: Callable[[], str], *, digest: bool = False) -> DataFrame:
    """``doc_id, start, ids`` (or their digest) of every document, read back from record files in the shared folder.

    ``start`` counts the ids of all documents before it. Rows that share a doc_id are records of their
    own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "records")
    starts = file_starts(write_records(docs, where, tokenizer))
    read = read_records(spark, where, digest=digest).join(starts, "file")
    return read.withColumn("start", F.col("file_start") + F.col("file_ids_before")).drop("file_start", "file_ids_before")
