"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document expects ``target / source size`` copies. Within a source the documents stand in a fixed
order; the expected copies are summed up along it from one random offset, and a document is emitted once
for each whole number that its stretch of the sum crosses. All sums are whole numbers of 2^-32 copies,
so they are the same in any order of adding.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.llm.rows import numbered
from beatwatch.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
ONE = 1 << 32
ROWS_PER_RANGE = 1_000_000


def digest(text: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of the MD5 as a whole number; every SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """``source, source_size, target`` of each source.

    Sources in code point order, null last, take the weights in turn and part ``share`` of all sizes by
    weight. A target stops at ``ceiling`` times its source's size; what that leaves is shared again by
    weight until no target is above its ceiling.

    The sharing has a closed form. Sources reach their ceiling in the order of size / weight, so with
    the sources in that order the first ``j`` are full for the least ``j`` whose next source stays below
    its ceiling at the rate (total - sum of ceilings before it) / (weights from it on). The running sums
    need all sources in one order: one row for each source, never the documents.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighed = (
        weighed.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_w_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.coalesce(F.lit(float(ceiling)) * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rate", (F.col("_total") - F.col("_full")) / F.col("_w_left"))
        .withColumn("_place", F.row_number().over(order))
    )
    limit = F.lit(float(ceiling)) * F.col("source_size")
    # the rate of the first source that stays below its ceiling holds for all from there on
    rate = F.min(F.when(F.col("_rate") * F.col("_w") <= limit, F.struct("_place", "_rate"))).over(everything)["_rate"]
    share_of = F.when(rate.isNull(), limit).otherwise(F.least(rate * F.col("_w"), limit))
    return weighed.select("source", "source_size", share_of.alias("target"))


def systematic_copies(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """The rows of ``sized`` (row, doc_id, source, size) with ``source_size``, ``target`` and ``copies``.

    Order within a source: size class (eight to the octave), then MD5 of seed and doc_id. Documents of a
    class and digest range are summed by one task; the sums of the ranges before it come from the
    range totals, so a source with any share of the rows is dealt over many tasks.
    """
    rows = sized.count()
    ranges = max(1, math.ceil(rows / ROWS_PER_RANGE))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = (
        sized.withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * F.lit(8.0) + F.lit(1e-6)).cast("int")).otherwise(-1))
        .withColumn("_at", digest(F.concat(F.lit(seed), name)))
        .withColumn("_range", F.floor(F.col("_at") * F.lit(ranges) / F.lit(1 << 32)).cast("int"))
    )
    totals = placed.groupBy("source", "_class", "_range").agg(F.count("*").alias("_rows"))
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(ONE))).cast("long")).otherwise(F.lit(0).cast("long"))
    rated = targets.withColumn("_step", rate).withColumn("_offset", digest(F.concat(F.lit(seed), F.lit("\u0001"), F.coalesce(F.col("source"), F.lit("\u0000")))))
    before = Window.partitionBy("source").orderBy("_class", "_range").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(
        F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    first = first.join(rated, first["_s"].eqNullSafe(rated["source"])).drop("source")
    same = placed["source"].eqNullSafe(first["_s"]) & (placed["_class"] == first["_c"]) & (placed["_range"] == first["_r"])
    within = Window.partitionBy("source", "_class", "_range").orderBy("_at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_nth", F.count("*").over(within)).join(first, same)
    # copies expected up to and with this row; decimals of 2^-32 copies would pass a long at 2^31 copies
    upto = (F.col("_before") + F.col("_nth")).cast("decimal(20,0)") * F.col("_step").cast("decimal(18,0)") + F.col("_offset")
    back = upto - F.col("_step")
    whole = lambda c: F.floor(c / F.lit(ONE)).cast("long")
    return summed.select("row", "doc_id", placed["source"], "size", "source_size", "target", (whole(upto) - whole(back)).alias("copies"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix-1",
    row: Column | None = None,
) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, copies`` of every document.

    ``row`` tells rows apart, by default their place in the scan. The narrow rows are written to the shared
    folder, so the texts are counted once and later steps see the same rows.

    Null or empty texts have size 0: they are rows of the result and add no words. A source whose texts
    are all empty has target 0 and no copies. Null sources form the last source. Rows that share a doc_id are documents of
    their own; equal ones may get different copies. Other columns are ignored.
    """
    where = shared_dir(docs.sparkSession, "mixing")
    place = F.monotonically_increasing_id() if row is None else row
    docs.select(place.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")).write.parquet(where)
    sized = docs.sparkSession.read.parquet(where)
    return systematic_copies(sized, source_targets(sized, weights, share, ceiling), seed)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as ``mix`` says.

    The rows are numbered in a copy in the shared folder, and the copies come back by that number. ``settings`` are
    those of ``mix``.
    """
    rows, row = numbered(docs)
    copies = mix(rows, row=F.col(row), **settings).filter("copies > 0").select(F.col("row").alias(row), F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias(f"{row}s"))
    found = rows.join(copies, row)
    return found.withColumn(f"{row}s", F.explode(f"{row}s")).select(*docs.columns)
