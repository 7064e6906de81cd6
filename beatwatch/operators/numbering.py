"""Numbers that tell equal rows apart, without a task for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
# buckets of keys for each chunk of rows, so that a bucket of more rows than a chunk has holds a hot key
BUCKETS = 16


def number_repeats(table: DataFrame, key: str | Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``table`` with ``ordinal``: the number of a row among those with its key, from 0.

    ``table`` is a scan of written files, whose rows have places. Rows are first counted by bucket of keys, which
    bounds the rows of each key in it. Rows of small buckets meet by key, in one shuffle. A bucket of more than
    ``chunk_rows`` rows may hold a hot key: its rows are counted by key and by chunk of a file, the counts summed along
    the chunks, and numbered within their chunk; so a key that a third of all rows hold is as many groups as there are
    chunks. A null key is a key of its own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    buckets = max(1, BUCKETS * table.count() // chunk_rows)
    placed = table.withColumns(
        {
            "_file": F.xxhash64("_metadata.file_path"),  # short to shuffle; two files of one number would be one
            "_row": F.col("_metadata.row_index"),
            "_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)),
        }
    )
    large = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).select("_bucket")
    if large.isEmpty():
        return _by_key(placed, keys).select(*table.columns, "ordinal")
    large = F.broadcast(large)  # at most one for each chunk of rows
    small, hot = placed.join(large, "_bucket", "left_anti"), placed.join(large, "_bucket", "left_semi")
    return _by_key(small, keys).select(*table.columns, "ordinal").unionByName(_by_chunk(hot, keys, chunk_rows).select(*table.columns, "ordinal"))


def _by_key(placed: DataFrame, keys: list[str]) -> DataFrame:
    within = Window.partitionBy(*keys).orderBy("_file", "_row")
    return placed.withColumn("ordinal", (F.row_number().over(within) - 1).cast("long"))


def _by_chunk(placed: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    chunked = placed.withColumn("_chunk", F.floor(F.col("_row") / chunk_rows))
    by = [*keys, "_file", "_chunk"]
    along = Window.partitionBy(*keys).orderBy("_file", "_chunk")
    counts = chunked.groupBy(*by).agg(F.count("*").alias("_n"))
    starts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in by], (F.sum("_n").over(along) - F.col("_n")).alias("_start"))
    meet = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    within = Window.partitionBy(*by).orderBy("_row")
    return chunked.join(starts, meet).withColumn("ordinal", F.col("_start") + F.row_number().over(within) - 1)


def unique_ids(events: DataFrame, column: str = "event_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Content ids made unique: the first of equal rows keeps its id, the others hash it with their number.

    Equal rows are alike, so the ids of a table depend on its rows alone, not on files or order: a second run gives the
    same ids. ``events`` is a scan of written files. Ids in hex travel as bytes, half as long; others as they are.
    """
    as_bytes = F.unhex(column)
    packed = events.withColumn("_bytes", F.when(F.lower(F.hex(as_bytes)) == F.col(column), as_bytes))
    packed = packed.withColumn("_text", F.when(F.col("_bytes").isNull(), F.col(column))).drop(column)
    numbered = number_repeats(packed, ["_bytes", "_text"], chunk_rows)
    content = F.coalesce(F.lower(F.hex("_bytes")), F.col("_text"))
    own = F.when(F.col("ordinal") == 0, content).otherwise(F.sha2(F.concat_ws("\x1f", content, F.col("ordinal").cast("string")), 256))
    return numbered.withColumn(column, own).select(*events.columns)
